"""Operators on small fixtures: brute force, round trips, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waymark.llm import chat, exact_dedup, html_text, near_dedup, packing, pieces, quality, topk, url_filter, warc
from waymark.session import scratch_path

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: doc_id, text and columns with names that the operators use themselves
DOCS = "doc_id long, text string, id string, locator string, n int, key string, cls string, __place string"
LONG = "word " * 30_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", 1, None, "x", None) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, ""), (4, "A b"), (5, "a B"), (5, "a B"), (None, "a b"), (None, "lone"), (6, LONG), (7, LONG), (8, "É"), (9, "é")]


# --- exact dedup ---------------------------------------------------------------------------


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1).substr(1, 1))) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(docs(spark, ODD), digest=digest).collect()
    groups = brute_groups(ODD)
    want = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_state_goes_on(spark):
    base = scratch_path(spark, "growing")
    state = scratch_path(spark, "state")
    for start in (0, 5):
        rows = spark.range(start, start + 5).select(F.col("id"), F.struct(F.lit("f").alias("file"), F.col("id").alias("row")).alias("locator"), F.unhex(F.hex(F.col("id") % 3)).alias("digest"))
        rows.write.mode("append").parquet(base)
        exact_dedup.advance(spark.readStream.schema(rows.schema).parquet(base), state)
    held = {r.keep.id: r.n for r in exact_dedup.held_state(spark, state).collect()}
    assert held == {9: 4, 7: 3, 8: 3}


def test_drop_copies_keeps_columns(spark):
    frame = docs(spark, ODD)
    left = exact_dedup.drop_copies(frame)
    assert left.columns == frame.columns
    assert left.count() == len(brute_groups(ODD))
    assert exact_dedup.drop_copies(frame.limit(0)).count() == 0


# --- near dedup ----------------------------------------------------------------------------


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate(UP).encode().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        members[find(i)].append(k)
    return [(k, len(sets[i]), min((x for x in members[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)]


def edited(rnd, base, n):
    words = base.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, width, percent):
    rnd = random.Random(3)
    texts = [" ".join(f"v{rnd.randrange(5000)}" for _ in range(rnd.randrange(40, 200))) for _ in range(20)]
    rows = [(i, edited(rnd, texts[i % 20], rnd.randrange(0, 8))) for i in range(260)] + [(None, None), (1000, ""), (1001, " \n"), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, LONG), (1006, LONG + "end"), (None, "one two"), (None, "solo text")]
    got = near_dedup.near_dedup(docs(spark, rows), width=width, percent=percent).collect()
    want = brute_components(rows, width, percent)
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(repr, want))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_dedup(docs(spark, []), width=width).count() == 0


def test_near_dedup_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rnd = random.Random(5)
    base = " ".join(f"v{rnd.randrange(5000)}" for _ in range(120))
    rows = [(i, edited(rnd, base, rnd.randrange(0, 12))) for i in range(200)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs(spark, rows), width=3, percent=85).collect()}
    assert got == set(brute_components(rows, 3, 85))


def test_near_dedup_of_a_long_chain(spark):
    """Each text is near to its neighbours only; all are one component."""
    rows = [(i, " ".join(f"w{j}" for j in range(8 * i, 8 * i + 104))) for i in range(500)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert len(got) == 500 and {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def test_components_of_paths(spark):
    """Two shuffled paths, one with shortcuts, a pair and a hub whose key is the largest."""
    rnd = random.Random(5)
    keys = rnd.sample(range(1, 10**9), 2000)
    edges = [(keys[i], keys[i + 1]) for i in range(1199)] + [(keys[i], keys[i + k]) for i in range(1200, 1797) for k in (1, 2, 3) if i + k < 1800]
    edges += [(keys[1800], keys[1801]), *((10**9, k) for k in keys[1802:]), (keys[5], keys[5])]
    frame = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges], "a binary, b binary")
    groups = collections.defaultdict(set)
    for r in near_dedup.components(frame).collect():
        groups[bytes(r.root)].add(int.from_bytes(r.cls, "big"))
    assert {frozenset(g) for g in groups.values()} == {frozenset(keys[:1200]), frozenset(keys[1200:1800]), frozenset(keys[1800:1802]), frozenset([10**9, *keys[1802:]])}
    assert sum(map(len, groups.values())) == 2001
    assert near_dedup.components(frame.limit(0)).count() == 0


def test_drop_near_copies(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other"), (4, ""), (5, None)]
    left = near_dedup.drop_near_copies(docs(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5]


def test_estimate_is_near_the_truth():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        union = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
        k = int(len(union) * share)
        rest = (len(union) - k) // 2
        a, b = union[: k + rest], np.r_[union[:k], union[k + rest :]]
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        both = near_dedup.registers(union)
        assert (np.maximum(x, y) == both).all()
        got = near_dedup.likeliest(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - share) < 5 * np.sqrt(share * (1 - share) / near_dedup.M)


# --- quality -------------------------------------------------------------------------------


def test_quality_learns_and_keeps_clean_text(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice("the of and river stone under house light water".split()) for _ in range(80)) + "."
    bad = lambda: " ".join(rnd.choice("BUY!! $$$ %%% CLICK!! ### WIN!!".split()) for _ in range(80))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)] + [(None, "x"), (9001, None), (9002, ""), (9003, LONG)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(1, 1), (None, 1), (5, None), (7, 3)], "doc_id long, quality int")
    frame = docs(spark, rows)
    model = quality.fit(frame, labels)
    out = frame.select("doc_id", quality.held_out(F.col("doc_id")).alias("held"), quality.score(model, F.col("text")).alias("s")).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.s <= 1 for r in out)
    held = [r for r in out if r.held and r.doc_id < 600]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert held and all((r.s >= 0.5) == (r.doc_id % 3 > 0) for r in held)
    assert quality.fit(frame, labels) == model
    assert quality.keep_good(frame, labels).columns == frame.columns


def test_quality_without_labels(spark):
    frame = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.s for r in frame.select(quality.score(quality.fit(frame, none), F.col("text")).alias("s")).collect()} == {0.5}
    assert quality.keep_good(frame.limit(0), none).count() == 0


# --- packing -------------------------------------------------------------------------------


def check_packed(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_are_those_of_the_tokenizers_file(tmp_path):
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["", "a b", "Ünï 12 <|endoftext|>x", LONG[:900]]
    same = packing.Checked(path, ranks)
    want = [same.slowly(t) for t in texts]
    assert same(texts) == want
    assert same.agreed
    with open(ranks, "rb") as f:
        lines = f.read().splitlines()
    other = tmp_path / "other"  # a rank file of another vocabulary: its merges are gone
    other.write_bytes(b"\n".join(lines[:300]))
    checked = packing.Checked(path, str(other))
    assert checked(texts) == want
    assert not checked.agreed


@pytest.mark.parametrize("ranked_rows", [1024, 3])
def test_packing(spark, ranked_rows, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANKED_ROWS", ranked_rows)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", " lead", "trail ", "x \n y", "<|endoftext|> z", "tab\tnew\n\nline  ", "é ñ 日本", *[f"word {i} " * (i % 50) for i in range(150)]]
    rows = [*ODD, *enumerate(texts, 100)]
    out = packing.pack(docs(spark, rows), capacity=256, ids=True).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        starts = [0, *range(len(ids) % 256 or 256, len(ids), 256)]
        for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == want
    used = check_packed(out, 256)
    assert used <= -(-sum(r.length for r in out) // 256) + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_plan_places_every_piece_once():
    rnd = random.Random(4)
    for _ in range(30):
        histogram = {rnd.randrange(1, 65): rnd.randrange(1, 60) for _ in range(rnd.randrange(1, 40))}
        plan = packing.plan(histogram, 64)
        for length, count in histogram.items():
            own = plan[plan.length == length]
            assert own.slots.sum() == count
            assert (own["first"] == own.slots.cumsum() - own.slots).all()
        fill = collections.Counter()
        for r in plan.itertuples():
            for q in range(r.slots):
                fill[r.base + q // r.per] += r.length
        assert max(fill.values()) <= 64
        rooms: list[int] = []  # best fit, piece by piece
        for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
            if fits := [r for r in rooms if r >= length]:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(64 - length)
        assert len(fill) == len(rooms)


def test_encoder_of_long_blanks():
    """The look-ahead of the pattern runs out of stack on a million blanks; ids stay those of the tokenizers file."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    end = packing.END_OF_TEXT
    for text in (" " * 2_000_000 + "word", "a" + "\n" * 1_200_000 + " b", " " * 1_100_000 + end + "w", "x" + "\u3000\t" * 600_000 + "." + end + " " * 150_000, " " * 150_000 + "\x1c" + " " * 150_000 + "é"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


# --- html ----------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav>Menu</nav><article><h1>T</h1><p>One&nbsp;two &amp; three.<br>four</p><aside>x</aside><p>Five<script>bad()</script></article><footer>f</footer>", "T\nOne two & three. four\nFive"),
    ("<div class='sidebar'>s</div><div><p>A long text, with marks, and more.</p><p>Next <b>bold</b> words, here.</p></div><div id=comments><p>Nice, very nice!</p></div>", "A long text, with marks, and more.\nNext bold words, here."),
    ("<article><p>Text</p><section class='comments'><p>Reply</p></section><form>Name <input></form><div class='ad-box'>Buy</div></article>", "Text"),
    ("<body class='has-sidebar'><main><p>unclosed<p>again<ul><li>a<li>b</ul></main>", "unclosed\nagain\na\nb"),
    ("<div><h1>Title</h1><p>" + "Some words, and more of them. " * 9 + "</p><h2>Part</h2><p>Short, though.</p></div><ol class=commentlist><li>Great, great!</ol><h3>More</h3><ul><li><a href=x>Link one</a><li><a href=y>Link two</a></ul>",
     "Title\n" + ("Some words, and more of them. " * 9).strip() + "\nPart\nShort, though."),
    ("plain &lt;text&gt; &#233;", "plain <text> é"), ("<!-- x --><style>p{}</style>", ""), ("", ""), (None, ""), ("<p>a<b", "a"), ("<title>t</title><textarea><p>x</textarea>", ""),
]


def test_html(spark):
    rows = spark.createDataFrame([(i, None if i == 1 else f"u{i}", h, "x", 0) for i, (h, _) in enumerate(PAGES)] + [(None, "u", "<p>" + LONG, "x", 0)] * 2, "page_id long, url string, html string, key string, text int")
    got = html_text.extract(rows).collect()
    assert {r.page_id: r.text for r in got if r.page_id is not None} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert [r.n_chars for r in got if r.page_id is None] == [len(LONG.strip())] * 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(rows.limit(0)).count() == 0


PROSE = "Some words, and more of them, stand here. " * 6


def test_html_ratios_decide_on_article_pages():
    links = "<ul>" + "<li><a href=x>Another story to read</a></li>" * 5 + "</ul>"
    page = f"<body><div>Top of page</div><article><h1>Title</h1><p>{PROSE}</p>{links}<p>{PROSE}</p><ol><li>Salt</li><li>Flour</li></ol></article><div>All rights</div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", PROSE.strip(), PROSE.strip(), "Salt", "Flour"])


@pytest.mark.parametrize("card", ["<article><p>Read this next</p></article>", "<article><a href=x>Read this next</a></article>"])
def test_html_teaser_article_takes_no_text_away(card):
    page = f"<body><div id=page><h1>Title</h1><div>{PROSE}</div><div>{PROSE}</div></div>{card}</body>"
    assert html_text.main_text(page) == "\n".join(["Title", PROSE.strip(), PROSE.strip()])


@pytest.mark.parametrize("outer", ["article", "div"])
@pytest.mark.parametrize(
    "tag, attrs, stays",
    [("section", "id='related-work'", True), ("div", "id='social-history'", True), ("div", "id=commentary", True), ("section", "id='legal-form'", True), ("div", "class=commentary", True),
     ("div", "id=comments", False), ("div", "class='post-comments'", False), ("div", "role=search", False), ("section", "class=comments", False)],
)
def test_html_marks(outer, tag, attrs, stays):
    page = f"<body><{outer}><p>{PROSE}</p><{tag} {attrs}><p>Other {PROSE}</p></{tag}></{outer}></body>"
    assert html_text.main_text(page) == "\n".join([PROSE.strip(), "Other " + PROSE.strip()][: 1 + stays])


@pytest.mark.parametrize("attrs", ["id='search-and-seizure'", "id='legal-form'", "id=commentary", "id=copyright", "class='related-work'"])
def test_html_marks_of_headings(attrs):
    for outer in ("article", "div"):
        assert html_text.main_text(f"<body><{outer}><h2 {attrs}>Title</h2><p>{PROSE}</p></{outer}></body>") == "Title\n" + PROSE.strip()


# --- url filter ----------------------------------------------------------------------------


def test_url_rules_and_templates(spark):
    rules = [("allow", "com", "/"), ("block", "bad.com", "/"), ("block", "net", "/x/")]
    urls = [None, "", "no scheme", "http://A.COM", "http://A.com/p?q#f", "ftp://x.BAD.com/Y", "http://notbad.com/", "http://h.net/x/1", "http://h.net/x/2?u=://z", "http://h.net/y/1", "http://h.org/a/b/c/d/e/f/g", "://only/p"]
    frame = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)] + [(None, urls[4], "x", "x")] * 2, "page_id long, url string, host string, template string")
    got = {r.page_id: r for r in url_filter.judge(frame, rules).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "", None, "allow"), ("a.com", "/p", "com/", "allow"), ("x.bad.com", "/Y", "bad.com/", "block"),
        ("notbad.com", "/", "com/", "allow"), ("h.net", "/x/1", "net/x/", "block"), ("h.net", "/x/2", "net/x/", "block"), ("h.net", "/y/1", None, "allow"), ("h.org", "/a/b/c/d/e/f/g", None, "allow"), ("only", "/p", None, "allow"),
    ]
    assert url_filter.judge(frame.limit(0), rules).count() == 0


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}/{chr(97 + i % 26)}{chr(97 + i % 23)}.html", None if i % 5 == 0 else i % 2 == 0) for i in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(frame, [], label=F.col("good")).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400))


def test_deep_branches_get_their_own_verdicts(spark):
    deep = "/".join("abcdef")
    rows = [(i, f"http://h/{deep}/{'spam' if i % 2 else 'news'}/{'x' * (i % 5 + 1)}/end", bool(i % 2 == 0)) for i in range(80)]
    rows += [(200, "http://h/" + "y/" * 400, None), (201, "http://h/" + "s" * 50_000, None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, good boolean"), [], label=F.col("good")).collect()}
    assert {i: r.verdict for i, r in got.items()} == {i: "block" if i < 200 and i % 2 else "allow" for i, _u, _g in rows}
    assert len({got[i].template for i in range(80)}) >= 2


def test_a_node_with_most_urls(spark):
    """Slugs are one variable branch, whatever their number; the branch beside them keeps its own purity."""
    rows = [(i, f"http://hot/en/title-{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}", None if i % 3 else i % 2 == 0) for i in range(1000)]
    rows += [(2000 + i, f"http://hot/ads/{i % 7}", False) for i in range(50)] + [(3000, "http://hot/en/title-new", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, good boolean"), [], label=F.col("good")).collect()}
    assert {got[i].template for i in range(1000)} == {got[3000].template}
    assert got[3000].template.endswith("/*")
    assert all(got[2000 + i].verdict == "block" for i in range(50))


# --- chat ----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a <|im_end|> & &lt;| b"), (1, 2, "assistant", "x<"), (1, 3, "user", "u"), (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, "user", None), (2, 1, None, "odd\nrole"),
            (3, None, "assistant", "first"), (3, 0, "assistant", "é" * 3), (3, 0, "assistant", "é" * 3), (None, 0, "user", LONG), (None, 1, "assistant", "<|im_start|>assistant\n"), (4, 0, "a\nb", "|im_end|>")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, example string, n int")
    made = chat.examples(frame)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    full = [r for r in chat.expand(made).collect() if r.conv_id == 1]
    assert [r.text[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in sorted(full, key=lambda r: r.example)] == ["x<", "", None]
    assert sum(len(r.text) for r in full) == got[1].formatted_chars
    assert all(b.text.startswith(a.text) for a, b in zip(sorted(full, key=lambda r: r.example), sorted(full, key=lambda r: r.example)[1:], strict=False))
    assert chat.digests(chat.examples(frame.limit(0))).count() == 0


def test_chat_digests_are_read_from_whole_examples(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"é{c}<|{t}&" * 5) for c in (1, 2) for t in range(7)] + [(None, 0, "user", "alone")]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = chat.expand(made)
    assert {"text", "last"} <= set(full.columns)
    dealt = chat.expand(made, chars=500)
    assert sorted(map(repr, full.collect())) == sorted(map(repr, dealt.collect()))
    for c in (1, 2):
        texts = sorted((r for r in full.collect() if r.conv_id == c), key=lambda r: r.example)
        assert [r.last for r in texts] == [False, False, False, True]
        assert all(b.text.startswith(a.text) for a, b in zip(texts, texts[1:], strict=False))
        assert sum(len(r.text) for r in texts) == next(r.formatted_chars for r in chat.digests(made).collect() if r.conv_id == c)


# --- warc ----------------------------------------------------------------------------------


def test_warc_round_trip_and_pushdown(spark):
    body = "<p>" + "x" * 200
    rows = [(3, "http://a/\r\nX: y", body), (1, "http://b", body), (2, None, body), (None, "http://c", body), (4, "http://d", "short"), (5, "http://e", "short"), (6, "http://f", None), (7, "http://g", "WARC/1.1\r\n\r\n" * 20), (8, "http://é", LONG)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.page_records(frame), path)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    assert {k: (r.warc_type, r.refers_to_page) for k, r in got.items() if r.warc_type == "revisit"} == {"3": ("revisit", "1"), "2": ("revisit", "1"), None: ("revisit", "1")}
    for k, _, html in rows:
        r, data = got[None if k is None else str(k)], (html or "").encode()
        assert r.payload_digest == "sha256:" + hashlib.sha256(data).hexdigest()
        assert r.payload_length == len(data)
        assert bytes(r.payload) == (b"" if r.warc_type == "revisit" else data)
    assert got["3"].target_uri == "http://a/%0D%0AX: y"
    assert got["2"].refers_to == got["1"].record_id
    light = warc.read_warc(spark, path, payload=False).where("warc_type = 'revisit' and target_uri like 'http://a%'")
    assert "payload" not in light.columns
    assert [r.page_id for r in light.collect()] == ["3"]
    empty = scratch_path(spark, "warc")
    warc.write_warc(warc.page_records(frame.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_reads_plain_and_packed_files(tmp_path):
    import gzip

    one = warc.record({"warc_type": "response", "record_id": "<a>", "payload": b"one", "payload_length": None})
    two = warc.record({"warc_type": "revisit", "record_id": "<b>", "payload_length": 3})
    (tmp_path / "x.warc").write_bytes(one + two)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    from pyspark.sql.types import StructType

    reader = warc.WarcReader(str(tmp_path), StructType.fromDDL("warc_type string, record_id string, payload binary, payload_length long"), True)
    found = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [(r["record_id"], r["payload"], r["payload_length"]) for r in found] == [("<a>", b"one", 3), ("<b>", b"", 3)] * 2


# --- top-k ---------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [4, 8])
def test_topk(spark, bits):
    rnd = random.Random(8)
    hot = [rnd.gauss(0, 1) for _ in range(20)]
    rows = [(i, hot if i % 3 == 0 else [x + rnd.gauss(0, 0.6) for x in hot] if i % 3 == 1 else [rnd.gauss(0, 1) for _ in range(20)], "x") for i in range(150)]
    rows += [(200, None, "x"), (201, [], "x"), (202, [float("nan"), None, 1.0], "x"), (7, rows[7][1], "x")]
    codes = topk.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string"), "vec_id", "embedding", bits)
    bit = lambda v: tuple(i < len(v) and v[i] is not None and v[i] > 0 for i in range(20))
    known = [(i, bit(v)) for i, v, _ in rows if v is not None]
    for k in (3, 400):
        got = collections.defaultdict(list)
        for r in topk.search(codes, codes.where("id % 10 = 0 or id > 200"), k, bits).collect():
            got[r.id].append((r.rank, r.distance, r.neighbour))
        for i, c in known:
            if i % 10 == 0 or i > 200:
                want = sorted((sum(x != y for x, y in zip(c, d, strict=True)), j) for j, d in known)[:k]
                assert sorted(got[i]) == [(n + 1, *w) for n, w in enumerate(want)]
    assert topk.search(codes.limit(0), codes.limit(0), 3, bits).count() == 0


# --- pieces --------------------------------------------------------------------------------


def test_pieces_match_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = pieces.read_model()
    texts = ["", " ", "  ", "a  b ", None, "ﬁ½Å\tx\n", "the singing then  the   end", "x" * 300 + " ab", "日本語 テスト 🎉", "▁ ▁", "<s> </s> <0x41>", LONG[:5000], "the singing then  the   end"]
    frame = docs(spark, list(enumerate(texts)))
    coded = pieces.encode(frame, model)
    got = {r.doc_id: (list(r.ids), r.back) for r in coded.select("doc_id", "ids", pieces.decode(F.col("ids"), model).alias("back")).collect()}
    assert got == {i: (sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in enumerate(texts)}
    assert pieces.encode(frame.limit(0), model).count() == 0


def test_unigram_fold(spark):
    rnd = random.Random(6)
    scores = {"▁": -2.0, **{w: -rnd.uniform(1, 9) for w in "a b c ab bc abc ▁a ▁ab ca cab".split()}}
    model = pieces.Model("unigram", tuple((p, i + 1, s) for i, (p, s) in enumerate(scores.items())), None, 0, min(scores.values()) - 10, 3, ())
    words = ["▁" + "".join(rnd.choice("abcx") for _ in range(rnd.randrange(0, 9))) for _ in range(60)] + ["▁" + "abc" * 40]
    got = {r.word: list(r.ids) for r in pieces.encode_words(spark.createDataFrame([(w,) for w in set(words)], "word string"), model).collect()}
    ids = {p: i for p, i, _ in model.pieces}

    def cost(parts):
        return sum(scores.get(p, model.unknown_score) for p in parts)

    def best(word):
        if not word:
            return []
        return max(([word[:k], *best(word[k:])] for k in range(1, min(3, len(word)) + 1) if word[:k] in scores or k == 1), key=cost)

    for w in set(words):
        if len(w) < 12:
            assert got[w] == [ids.get(p, 0) for p in best(w)]
        else:
            assert got[w] == [ids.get(p, 0) for p in pieces.segment(w, scores, "unigram", model.unknown_score, 3)]


def test_words_fold_in_the_task_that_reads_their_text(spark):
    rnd = random.Random(3)
    model = pieces.read_model()
    words = {"▁" * rnd.randrange(0, 3) + "".join(rnd.choice("aeinrst日🎉é'-0") for _ in range(rnd.randrange(1, 61))) for _ in range(400)} | {"▁", "▁the", "▁" + "x" * 80}
    folds = pieces.Folds(model)
    assert folds.fold(words) == {w: folds.alone(w) for w in words}
    # several pieces of one score: the leftmost merges first
    even = pieces.Model("bpe", tuple((p, i + 1, s) for i, (p, s) in enumerate({"a": -9.0, "b": -9.0, "ab": -1.0, "ba": -1.0, "aba": -2.0, "bab": -2.0}.items())), None, 0, -19.0, 3, ())
    folds, words = pieces.Folds(even), {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12))) for _ in range(200)}
    assert folds.fold(words) == {w: folds.alone(w) for w in words}
    # no occurrence of a word is moved
    coded = pieces.encode(docs(spark, [(1, "the end"), (2, None)]), model)
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
