"""Fixed values that the results depend on: word lists, limits and patterns."""

from __future__ import annotations

# Levels, in report order: depth, tool and reason ranges, crawl depth.
LEVELS = ["easy", "medium", "hard", "extreme"]
LEVEL_CONFIG = [
    ("easy", 3, 6, 1, 2, 1, 2, 1),
    ("medium", 7, 12, 2, 4, 2, 3, 2),
    ("hard", 13, 16, 4, 5, 3, 4, 3),
    ("extreme", 17, 21, 5, 7, 4, 6, 3),
]
LEVEL_CONFIG_SCHEMA = (
    "level string, depth_min int, depth_max int, tool_min int, tool_max int, "
    "reason_min int, reason_max int, crawl_depth int"
)
TRIAL_SECONDS = 600

STOP_TYPES = ["page", "tool", "reason", "compute"]
BRIDGE_TYPES = ["link_follow", "search_query", "tool_call", "compute"]
VALUE_TYPES = ["number", "text", "url", "coords", "date"]

VALID_TOOLS = [
    "fetch_webpage", "weather_historical", "weather_forecast", "python_generate_code",
    "python_execute_code", "search_query", "maps_geocode", "maps_reverse_geocode",
    "maps_search_places", "maps_place_details", "maps_distance_matrix", "maps_elevation",
    "maps_directions", "countries_population", "countries_area", "stock_historical_price",
    "stock_volume", "crypto_historical_price", "crypto_volume",
]
STOCK_TOOLS = ["stock_historical_price", "stock_volume"]
ZERO_SUSPICIOUS_TOOLS = [
    "stock_historical_price", "stock_volume", "crypto_historical_price", "crypto_volume",
    "countries_population", "countries_area", "maps_geocode", "maps_elevation",
]

COMMON_WORDS = [
    "the", "and", "for", "that", "this", "with", "from", "have", "will", "been", "were", "are",
    "was", "has", "its", "can", "not", "but", "all", "one", "two", "new", "old", "may",
]

# Number words and signs.
FRACTIONS = {"½": 0.5, "⅓": 1 / 3, "⅔": 2 / 3, "¼": 0.25, "¾": 0.75}
MAGNITUDES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80,
    "ninety": 90, "hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9,
    "trillion": 10**12,
}
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]
ROMAN_DIGIT_LENGTHS = [0, 1, 2, 3, 2, 1, 2, 3, 4, 2]
LETTER_POINTS = {1: "AEILNORSTU", 2: "DG", 3: "BCMP", 4: "FHVWY", 5: "K", 8: "JX", 10: "QZ"}

# Unit conversions: (from, to, factor).
UNIT_FACTORS = [
    ("meters", "feet", 3.28084),
    ("km", "miles", 0.621371),
    ("meters", "yards", 1.09361),
    ("celsius", "fahrenheit_offset", 1.8),
]

# Pages and links.
SITE = "https://en.wikipedia.org"
ARTICLE_PREFIX = "https://en.wikipedia.org/wiki/"
EXCLUDED_NAMESPACES = [
    "Special:", "File:", "Category:", "Talk:", "Help:", "Wikipedia:", "Template:", "Portal:",
    "Module:", "Draft:", "User:", "MediaWiki:",
]
DULL_TITLE = r"(?i)^\d{3,4}$|^\d{1,2}(st|nd|rd|th)_century$|^List_of_|^Index_of_"
NAVIGATION_SECTIONS = [
    "see also", "references", "external links", "further reading", "notes", "bibliography", "sources",
]
GENERIC_TITLES = [
    "Main Page", "Wikipedia", "English language", "United States", "United Kingdom",
    "Mathematics", "Physics", "Computer science", "Science", "History", "Geography",
    "Philosophy", "Religion", "Music", "Art", "Literature", "Education", "Technology",
    "Engineering", "Medicine", "Biology", "Chemistry", "Economics", "Sociology", "Psychology",
    "Politics", "Europe", "Asia", "Africa", "North America", "South America", "Latin",
    "Greek language", "French language", "German language", "Spanish language",
    "Chinese language", "Japanese language", "Pi", "Geometry", "Trigonometry", "Algebra",
    "Free content", "Encyclopedia", "Internet", "World War I", "World War II",
]
CHROME_END = "From Wikipedia, the free encyclopedia"
BOILERPLATE_LINES = [
    "main menu", "move to sidebar", "hide", "navigation", "search", "personal tools", "contents",
    "toggle the table of contents", "article", "talk", "from wikipedia, the free encyclopedia",
    "appearance", "general", "not logged in",
]
BOILERPLATE_PARTS = [
    "Jump to content", "- Wikipedia", "[Jump to", "From Wikipedia",
    "Toggle the table of contents", "move to sidebar", "Main menu", "Toggle ", "Create account",
]
DROPPED_ELEMENTS = [
    "script", "style", "noscript", "template", "canvas", "math", "iframe", "object", "embed",
    "applet", "audio", "video",
]
VOID_ELEMENTS = ["meta", "link", "base", "source", "track", "param", "area", "col", "input"]
EMPTY_MARKDOWN = "(No readable content found.)"

# Seed quality.
BAD_TITLE = (
    r"(?i)^(List of |Lists of |Index of |Outline of |Glossary of |Timeline of |Comparison of |Bibliography of |"
    r"History of |Deaths in |Template:|Category:|Portal:|Draft:|Wikipedia:|Module:|File:|Help:|Talk:|User:|Special:|"
    r".*\(disambiguation\)|.*\(journal\)|.*\(magazine\)|.*\(TV series\)|.*\(TV programme\)|.*\(season \d|"
    r".*\(film series\)|\d{4}\b|ISO \d|IEEE \d|RFC \d)"
)
FICTION_TITLE = r"(?i)\(fictional\)|\(comics\)|\(character\)|\(video game\)|\(album\)|\(song\)|\(single\)|\(EP\)"
TAXONOMY_KEYS = [
    "kingdom", "phylum", "subphylum", "class", "order", "suborder", "infraorder", "family", "subfamily",
    "superfamily", "genus", "subgenus", "species", "subspecies", "domain", "clade", "subdivision", "binomial",
    "binomial name", "authority", "type species", "type genus", "tribe", "subtribe",
]

# Infobox facts: key pattern, value type, description; the first that matches and survives wins.
FACT_PATTERNS = [
    ("elevation", "number", "the elevation listed in the infobox"),
    ("population", "number", "the population listed in the infobox"),
    ("area", "number", "the area listed in the infobox"),
    ("founded|established|inception", "number", "the founding/establishment year in the infobox"),
    ("coordinates|coord", "coords", "the coordinates listed in the infobox"),
    ("^capital$", "text", "the capital listed in the infobox"),
    ("^country$", "text", "the country listed in the infobox"),
    ("^language|official.lang", "text", "the official language listed in the infobox"),
    ("height|altitude", "number", "the height listed in the infobox"),
    ("^length$", "number", "the length listed in the infobox"),
    ("^capacity|seats$", "number", "the capacity listed in the infobox"),
    ("^(gdp|GDP)", "number", "the GDP listed in the infobox"),
    ("^opened$", "number", "the opening year listed in the infobox"),
    ("^architect$", "text", "the architect listed in the infobox"),
    ("^location$", "text", "the location listed in the infobox"),
    ("^(date|start.date|end.date)$", "date", "the date listed in the infobox"),
]

# Places, countries, tickers, coins.
PLACE_WORDS = [
    "city", "town", "village", "county", "district", "province", "state", "island", "mount", "lake", "river",
    "bridge", "park", "station", "airport", "harbor", "harbour", "port",
]
NON_PLACE_WORDS = [
    "national", "team", "union", "league", "championship", "cup", "sultanate", "dynasty", "empire", "kingdom",
    "olympique", "athletic", "football", "rugby", "cricket", "university", "institute", "academy", "college",
    "wikipedia", "disambiguation",
]
PLACE_PARTICLES = ["city", "bay", "mount", "new", "san", "los", "el", "la", "fort", "st.", "saint"]
LOCATION_KEYS = [
    "location", "city", "capital", "headquarters", "seat", "place", "venue", "ground", "stadium", "birth_place",
    "birthplace", "death_place", "deathplace", "home_town", "hometown", "native_place", "residence",
    "coordinates", "coord",
]
COORDINATE_PREFIXES = ["coordinates", "coord", "coords", "latd", "latitude"]
COUNTRY_KEYS = ["country", "nation", "sovereign state"]
TICKER_KEYS = ["traded_as", "ticker_symbol", "stock_symbol", "trading_symbol"]
EXCHANGE = r"(?:NYSE|NASDAQ|TSE|LSE|HKEX|SGX|SZSE|SSE|KRX|TSX)[:\s]+([A-Z]{1,5})"
NOT_TICKERS = [
    "THE", "AND", "FOR", "INC", "LTD", "PLC", "CO", "USD", "EUR", "GBP", "JPY", "CNY", "HKD", "CAD",
]
COIN_KEYS = ["ticker_symbol", "symbol", "code", "ticker symbol"]
COIN_PAIRS = {
    "bitcoin": "BTCUSDT", "ethereum": "ETHUSDT", "binance coin": "BNBUSDT", "bnb": "BNBUSDT", "solana": "SOLUSDT",
    "cardano": "ADAUSDT", "dogecoin": "DOGEUSDT", "ripple": "XRPUSDT", "xrp": "XRPUSDT", "polkadot": "DOTUSDT",
    "litecoin": "LTCUSDT", "avalanche": "AVAXUSDT", "chainlink": "LINKUSDT", "polygon": "MATICUSDT",
    "tron": "TRXUSDT", "shiba inu": "SHIBUSDT", "uniswap": "UNIUSDT", "stellar": "XLMUSDT", "monero": "XMRUSDT",
    "toncoin": "TONUSDT",
}
KNOWN_COUNTRIES = [
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Argentina", "Armenia", "Australia", "Austria",
    "Azerbaijan", "Bahamas", "Bahrain", "Bangladesh", "Barbados", "Belarus", "Belgium", "Belize", "Benin", "Bhutan",
    "Bolivia", "Bosnia and Herzegovina", "Botswana", "Brazil", "Brunei", "Bulgaria", "Burkina Faso", "Burundi",
    "Cambodia", "Cameroon", "Canada", "Chad", "Chile", "China", "Colombia", "Congo", "Costa Rica", "Croatia", "Cuba",
    "Cyprus", "Czech Republic", "Denmark", "Djibouti", "Dominican Republic", "Ecuador", "Egypt", "El Salvador",
    "Estonia", "Ethiopia", "Fiji", "Finland", "France", "Gabon", "Gambia", "Georgia", "Germany", "Ghana", "Greece",
    "Guatemala", "Guinea", "Guyana", "Haiti", "Honduras", "Hungary", "Iceland", "India", "Indonesia", "Iran", "Iraq",
    "Ireland", "Israel", "Italy", "Jamaica", "Japan", "Jordan", "Kazakhstan", "Kenya", "Kuwait", "Laos", "Latvia",
    "Lebanon", "Libya", "Lithuania", "Luxembourg", "Madagascar", "Malaysia", "Mali", "Malta", "Mexico", "Moldova",
    "Monaco", "Mongolia", "Montenegro", "Morocco", "Mozambique", "Myanmar", "Namibia", "Nepal", "Netherlands",
    "New Zealand", "Nicaragua", "Niger", "Nigeria", "North Korea", "North Macedonia", "Norway", "Oman", "Pakistan",
    "Panama", "Paraguay", "Peru", "Philippines", "Poland", "Portugal", "Qatar", "Romania", "Russia", "Rwanda",
    "Saudi Arabia", "Senegal", "Serbia", "Singapore", "Slovakia", "Slovenia", "Somalia", "South Africa",
    "South Korea", "Spain", "Sri Lanka", "Sudan", "Suriname", "Sweden", "Switzerland", "Syria", "Taiwan", "Tanzania",
    "Thailand", "Togo", "Trinidad and Tobago", "Tunisia", "Turkey", "Uganda", "Ukraine", "United Arab Emirates",
    "United Kingdom", "United States", "Uruguay", "Uzbekistan", "Venezuela", "Vietnam", "Yemen", "Zambia", "Zimbabwe",
]

# Date sources of the tools that need a day: infobox key words, year pattern in the lead, day in that year, default.
ANY_YEAR = r"\b(1[89]\d{2}|20[0-2]\d)\b"
TOOL_DATES = [
    ("geocode_weather_historical", ["date", "founded", "opened", "established"], ANY_YEAR, "-07-01", None),
    ("geocode_weather_precipitation", ["date", "founded", "opened", "established"], ANY_YEAR, "-07-01", None),
    ("historical_snowfall", ["date", "founded", "opened", "established"], ANY_YEAR, "-01-15", None),
    ("historical_sunshine", ["date", "founded", "opened", "established"], ANY_YEAR, "-06-21", None),
    ("date_computation", ["date", "founded", "opened"], None, None, None),
    ("stock_price", ["date", "founded", "ipo", "listed", "opened"], r"\b(20[0-2]\d)\b", "-06-15", "2024-06-15"),
    ("stock_volume", ["date", "founded", "ipo", "listed", "opened"], r"\b(20[0-2]\d)\b", "-06-15", "2024-06-15"),
    ("crypto_price", ["date", "released", "launched"], r"\b(20[12]\d)\b", "-06-15", "2024-06-15"),
    ("crypto_volume", ["date", "released", "launched"], r"\b(20[12]\d)\b", "-06-15", "2024-06-15"),
]

# Tool templates: planned names, and the order in which others are tried.
FALLBACK_TEMPLATES = [
    "geocode_elevation", "nearby_poi_count", "place_rating", "country_population", "country_area",
    "geocode_weather_historical", "historical_snowfall", "historical_sunshine", "geocode_distance",
    "geocode_directions_duration", "geocode_weather_precipitation", "math_conversion", "date_computation",
]
MARKET_TEMPLATES = ["stock_price", "stock_volume", "crypto_price", "crypto_volume"]
POI_TYPES = [
    "museums", "restaurants", "parks", "hotels", "hospitals", "universities", "libraries", "stadiums", "temples", "churches",
]
AUGMENT_DATE = "2024-01-15"

# Diamonds: name, source, branch A and B templates; number of diamonds per level.
DIAMONDS = [
    ("elevation_poi", "location", "geocode_elevation", "nearby_poi_count"),
    ("elevation_rating", "location", "geocode_elevation", "place_rating"),
    ("country_pop_area", "country", "country_population", "country_area"),
    ("weather_precip", "location", "geocode_weather_historical", "geocode_weather_precipitation"),
]
DIAMONDS_PER_LEVEL = [("easy", 1, 1), ("medium", 1, 2), ("hard", 2, 3), ("extreme", 3, 5)]

# Infobox rows, bold pairs, headings and links of a page's markdown.
TABLE_ROW = r"(?Umd)^\|\s*\*?\*?([^|*]+?)\*?\*?\s*\|\s*(.+?)\s*\|?\s*$"
BOLD_PAIR = r"(?Umd)\*\*([^*]+?)\*\*\s*:?\s+(.+?)(?:\n|$)"
HEADING = r"(?Umd)^#{1,6}\s+(.+)"
MARKDOWN_LINK = r"\[([^\]]+)\]\((/wiki/(?:[^()\s\"#]++|\([^()]*\))++)(?:#[^\s)\"]*)?(?:\s[^)]*)?\)"

# Round-trip plans: tool kinds and the words that name them in a plan step (plain substrings).
TOOL_WORDS = {
    "elevation": ["elevation", "altitude", "height above sea"],
    "weather": ["weather", "temperature", "precipitation", "rain"],
    "snowfall": ["snow", "snowfall"],
    "sunshine": ["sunshine", "sunlight", "daylight duration"],
    "distance": ["distance", "how far"],
    "directions": ["driving time", "duration", "travel time", "drive"],
    "places": ["nearby", "poi", "how many.*near", "count.*near", "museums", "restaurants", "parks"],
    "rating": ["rating", "star", "review"],
    "population": ["population", "people", "inhabitants"],
    "area": ["area", "square kilometer", "km²", "sq km", "land area"],
    "conversion": ["convert", "conversion", "unit"],
    "computation": ["arithmetic", "comput", "calculat", "days between", "date", "formula", "modulo", "digit"],
    "reasoning": ["transform", "digital root", "prime", "divisor", "scrabble", "vowel", "binary", "roman numeral", "leap year", "day of week", "reverse", "alphabetical position", "digit sum"],
}
FORMULA_WORDS = ["arithmetic", "comput", "mod", "digit", "formula", "passcode", "final"]
PLAN_FIELDS = ["page_or_topic", "what_to_find", "tool_or_method", "result_used_for"]
