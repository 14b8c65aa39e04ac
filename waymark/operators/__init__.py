"""Jobs: every public function takes and returns DataFrames."""
