"""Every operator against a plain version written from its contract, on the smallest tables and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import chat, decontam, htmltext, langid, mixing, quality, queries, sharding, simhash, tokens, url_filters

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "same text here now", "en", "a"), (4, "same text here now", "en", "a"),
    (None, "no id", None, "b"), (6, "word " * 3000, "en", "b"), (7, "a b c d e f g h\n" * 3 + "tail", "fr", None), (8, "ÉTÉ à la plage; Straße 😀 x" * 5, "fr", "a"),
    (9, "aaa" * 4000, None, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "kept", 5) for r in ODD], "doc_id long, text string, lang string, source string, shard string, n_words int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def empty(df):
    return df.limit(0)


# ---- 4


def plain_quality(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {k for i in range(len(ws) - 7) if wins[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(docs, odd):
    for df in (docs, odd):
        for r in rows(quality.judge(df)):
            want = plain_quality(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r["base_failed"] and r["kept"])
    assert quality.judge(empty(odd)).count() == 0
    assert quality.accepted(odd).columns == odd.columns


def test_quality_keeps_labelled_documents(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    got = {(r["quality"], r["kept"]): r["n"] for r in rows(judged.groupBy("quality", "kept").agg(F.count("*").alias("n")))}
    assert got.get((1, False), 0) == 0
    assert got.get((0, True), 0) <= 0.1 * (got.get((0, True), 0) + got[0, False])


# ---- 7


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, items):
    ws = norm(text)
    hit, found = set(), set()
    for item, iw in items:
        n = min(10, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for k in range(len(ws) - n + 1):
                if ws[k] == iw[i] and ws[k : k + n] == iw[i : i + n]:
                    hit |= set(range(k, k + n))
                    found.add(item)
    return len(ws), len(hit), sorted(map(str, found))


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rows(queries.op7_decontamination(spark, SF))
    assert len(got) == len(texts)
    assert any(r["contaminated"] for r in got)
    for r in got:
        n, hit, found = plain_scan(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0)


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "A b"), (2, None), (3, "..."), (None, "no ID"), (5, "a b c d e f g h a b c"), (1, "A b")], "item_id long, text string")
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows(decontam.scan(odd, bench)))
    want = []
    for d, t, *_ in ODD:
        n, hit, found = plain_scan(t, items)
        want.append((str(d), n, hit, tuple(x for x in found if x != "None")))
    assert got == sorted(want)
    assert decontam.scan(odd, empty(bench)).where("n_hit > 0").count() == 0
    assert decontam.scan(empty(odd), bench).count() == 0
    left = rows(decontam.clean(odd, bench))
    assert {r["doc_id"] for r in left} == {1, 2, 3, 4, 6, 8, 9} and len(left) == 8
    cut = {r["doc_id"]: r["text"] for r in rows(decontam.cut(odd, bench))}
    assert cut[7] == "d e f g h tail" and cut[4] == "same text here now"


# ---- 2


def test_sharding(docs, odd):
    for df in (docs, odd):
        got = rows(sharding.sharded(df))
        n = len(got)
        assert n == df.count()
        assert sorted(r["row_number"] for r in got) == list(range(n))
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
            p = sharding.permuted_number(r["row_number"], n, 20)
            assert (p % 8, p // 8) == (r["shard"], r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(8)) <= 1
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    a = sorted(map(str, rows(sharding.sharded(docs.repartition(7)))))
    assert a == sorted(map(str, rows(sharding.sharded(docs))))
    assert sharding.sharded(empty(odd)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 1000])
def test_permutation(n):
    assert sorted(sharding.permuted_number(k, n, 3) for k in range(n)) == list(range(n))


# ---- 6


def test_token_counts(spark, docs, odd):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.vocabulary())
    extra = spark.createDataFrame([(k, s, None, None, "x", 0) for k, s in enumerate(["ΣΑΣ ΟΔΟΣ İstanbul ǅ", "<|endoftext|> a<|startoftext|>", "it's we'LL 12345 ½ ²", "e\u0301\u00a0\u2003x\u200b", "日本語 テスト 한국어", "a\x00b\x1c\x85c", "ﬁ ſ K"])], odd.schema)
    for df in (docs, odd, extra):
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = Counter((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in texts)
        got = rows(tokens.counts(df))
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert tokens.counts(empty(odd)).count() == 0


# ---- 8


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    out = rows(got.where("held_out and length(lang) > 0"))
    right = sum(r["lang"] == r["lang_pred"] for r in out)
    assert right >= 0.93 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    for r in rows(langid.identify(docs.limit(200))):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    said = rows(langid.identify(odd))
    assert len(said) == len(ODD)
    assert {r["lang_pred"] for r in said if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.identify(empty(odd)).count() == 0


# ---- 9


def plain_fingerprint(text, width=3):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] or ([b" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, linked):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(fps[i], fps[j]):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash(spark, docs, odd):
    for df in (docs, odd):
        data = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
        comp = plain_components([d for d, _ in data], [f for _, f in data], lambda a, b: (a ^ b).bit_count() <= 3)
        want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(data, comp, strict=True))
        g = simhash.grouped(df)
        got = Counter((r["doc_id"], r["f"], r["component_id"]) for r in rows(g.withColumn("f", simhash.hex_digits(F.get("fps", F.lit(0))))))
        assert got == want
    assert simhash.grouped(empty(odd)).count() == 0


def test_bk_forest_finds_all_links():
    import random

    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        f = rnd.choice(fps)
        for _ in range(rnd.randint(1, 4)):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    want = plain_components(list(range(len(fps))), fps, lambda a, b: (a ^ b).bit_count() <= 3)
    up = {n: r for r, n in simhash.forest(fps, 3)}
    assert [up.get(n, n) for n in range(len(fps))] == want


def test_links_cut_hot_shards(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = [base]
    for _ in range(150):
        f = rnd.choice(fps)
        for _ in range(rnd.randint(2, 5)):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    want = plain_components(list(range(len(fps))), fps, lambda a, b: (a ^ b).bit_count() <= 3)
    nodes = spark.createDataFrame([(n, [f - (1 << 64) if f >> 63 else f], None) for n, f in enumerate(fps)], "node long, fps array<long>, sketch binary")
    up = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    assert [up.get(n, n) for n in range(len(fps))] == want


def test_deduplicated(spark, odd):
    left = simhash.deduplicated(odd)
    assert left.columns == odd.columns
    assert Counter(r["doc_id"] for r in rows(left))[4] == 1
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = rows(simhash.deduplicated(docs))
    assert len({r["text"] for r in kept}) == len(kept)
    sets = {}
    for r in kept:
        w = norm(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    inv = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inv[x].append(d)
    shared = Counter((a, b) for v in inv.values() if len(v) < 50 for i, a in enumerate(v) for b in v[i + 1 :])
    similar = [p for p, n in shared.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.9]
    assert not similar
    # Nothing goes whose text resembles no other text.
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["text"] for r in kept} <= set(whole.values())


# ---- 10


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad big">Buy</div><div id='cookie-notice'>We use</div>
<article><h1>Title &amp; more</h1><p>One<br>two &lt;b&gt; <b>bold</b> text<p>Next
 para<form><input>send</form><aside>side</aside><div class="comments"><p>me too</p></div><p>last &copy; &#233;</article><footer>foot</footer></body>"""


def test_html_article():
    page = htmltext.blocks(PAGE)
    assert htmltext.main_text(page) == "Title & more\nOne\ntwo <b> bold text\nNext para\nlast © é"


def test_html_classes():
    text = lambda inner, more="": htmltext.main_text(htmltext.blocks(f"<body><article><p>own</p>{inner}</article>{more}</body>"))
    assert text("", '<article class="comment">reader says</article>') == text('<article class="user-comment comment">reader says</article>') == "own"
    assert text('<p class="related-work">Earlier work</p><div class="search-results-analysis">Tables</div>') == "own\nEarlier work\nTables"
    assert text('<div class="related-posts">More</div><ul class="social-share">x</ul><div class="x comment-list">y</div><div role="search">z</div>', '<div class="search-results-analysis">Tables</div>') in ("own", "own\nx")
    assert htmltext.main_text(htmltext.blocks('<div class="search-results-analysis">Tables</div><p>own')) == "own"


def test_html_differencing_weighs_structure(spark):
    page = lambda n, marked: f"<p>Site name</p>{'<article>' if marked else '<div>'}<p>Quoted passage</p><p>own {n}</p>{'</article>' if marked else '</div>'}<p>Contact us</p>"
    df = spark.createDataFrame([(k, f"https://h.example/{k}", page(k, k % 2 == 0), 1, "x") for k in range(6)], "page_id long, url string, html string, _key int, shared string")
    got = {r["page_id"]: r["text"] for r in rows(htmltext.extract(df))}
    # What a neighbour has too goes from an unmarked page, and stays in a marked article.
    assert got == {k: f"own {k}" if k % 2 else f"Quoted passage\nown {k}" for k in range(6)}


def test_html_long_pages(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "TABLE", 1000)
    a, b = [f"x{k % 70}" for k in range(400)], [f"x{k % 90}" for k in range(300)]
    whole = htmltext.in_common(a, b)
    monkeypatch.setattr(htmltext, "TABLE", 1 << 28)
    assert len(whole) == len(htmltext.in_common(a, b)) and [a[i] for i in sorted(whole)]
    it = iter(b)
    assert all(any(x == y for y in it) for x in (a[i] for i in sorted(whole)))
    long = "<p>" + "</p><p>".join(f"line {k}" for k in range(60_000)) + "</p>"
    df = spark.createDataFrame([(1, "https://h.example/a", long), (2, "https://h.example/b", long.replace("line 7<", "own<"))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows(htmltext.extract(df))}
    assert got == {1: "line 7", 2: "own"}


def test_html_differencing(spark):
    common = "<p>Site name</p><p>{}</p><p>Contact us</p>"
    data = [(k, f"https://h.example/{k}", common.format(f"own words {k}")) for k in range(6)]
    data += [(10, None, None), (11, "x", ""), (12, "https://h2.example/a", "<p>alone</p>"), (12, "https://h2.example/a", "<p>alone</p>"), (13, "https://h2.example/b", "<p>alone again"), (14, "https://h2.example/b", "<p>&nbsp;</p>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    got = rows(htmltext.extract(df))
    assert len(got) == len(data)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[k] == f"own words {k}" for k in range(6))
    assert text[10] == text[11] == text[14] == "" and text[12] == "alone" and text[13] == "alone again"
    assert htmltext.extract(empty(df)).count() == 0


def test_html_differencing_at_any_partitioning(spark):
    common = "<p>Site name</p><p>{}</p><p>Contact us</p>"
    own = ["a"] * 5 + ["b", "c", "c", "c"] + ["d"] * 7
    df = spark.createDataFrame([(k, f"https://h.example/{k:03d}", common.format(x)) for k, x in enumerate(own)], "page_id long, url string, html string")
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r["page_id"]: r["text"] for r in rows(htmltext.extract(df))}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert [got[k] for k in range(len(own))] == own


def test_html_pages_are_the_articles(spark):
    pages = rows(spark.read.parquet(f"{SF}/pages.parquet"))
    got = {r["page_id"]: r["text"] for r in rows(htmltext.extract(spark.read.parquet(f"{SF}/pages.parquet")))}
    import html

    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br|ul|li|table|tr|td|div|blockquote|h2|pre)\b[^>]*>", inner)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert got[p["page_id"]] == "\n".join(x for x in want if x)


def test_common_subsequence():
    import difflib
    import random

    rnd = random.Random(1)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        got = sorted(htmltext.in_common(a, b))
        assert len(got) == length(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)
    assert difflib


# ---- 1


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, said in url_filters.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, said)
    return host, path, *(best or (None, None))


def test_url_rules(spark):
    urls = [r["url"] for r in rows(spark.read.parquet(f"{SF}/pages.parquet"))]
    urls += [None, "", "no scheme", "http://ORG", "http://org/", "http://Example.ORG/es/1", "https://a.example.org/en/1x?q=://", "ftp://xcom/fr/1", "http://a.com/fr", "http://a.com/de/?x", "a://b://c/d", "http://É.com/fr/x", "http://x.org/a\nb"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in rows(url_filters.judge(df))}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule, said = plain_rule(u)
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (said is None or r["verdict"] == said)
    assert url_filters.judge(empty(df)).count() == 0


def test_url_templates_learn_from_labels(spark):
    data = [(f"http://s.example/spam/{k}", 1) for k in range(40)] + [(f"http://s.example/news/{k}", 0) for k in range(40)]
    data += [("http://s.example/spam/999", None), ("http://s.example/news/999", None), ("http://s.example/other/1", None), ("http://t.example/x", None)]
    data += [(f"http://u.example/{chr(97 + k % 26)}{chr(97 + k // 26)}/p", 1) for k in range(90)] + [("http://u.example/zz/p", None)]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(data)], "page_id long, url string, bad int")
    got = {r["url"]: r for r in rows(url_filters.judge(df, rules=(), label="bad"))}
    assert got["http://s.example/spam/999"]["verdict"] == "block"
    assert got["http://s.example/news/999"]["verdict"] == "allow"
    assert got["http://u.example/zz/p"]["verdict"] == "block" and got["http://u.example/zz/p"]["template"] == "/*/p"
    assert got["http://t.example/x"]["verdict"] == "allow"


def test_url_branches_differ_among_many(spark):
    def learned(n):
        names = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n)]
        data = [(f"http://s.example/{x}/{k}", 0) for x in names for k in range(9)] + [(f"http://s.example/spam/{k}", 1) for k in range(40)]
        data += [("http://s.example/spam/999", None), ("http://s.example/aa/999", None)]
        df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(data)], "page_id long, url string, bad int")
        return {r["url"]: r["verdict"] for r in rows(url_filters.judge(df, rules=(), label="bad"))}

    for n in (62, 63, 200):
        got = learned(n)
        assert got["http://s.example/spam/999"] == "block" and got["http://s.example/aa/999"] == "allow"


def test_url_branches_differ_far_down(spark):
    data = [(f"http://s.example/a/b/c/d/e/{x}/{k}", b) for x, b in (("spam", 1), ("news", 0)) for k in range(40)]
    data += [("http://s.example/a/b/c/d/e/spam/999", None), ("http://s.example/a/b/c/d/e/news/999", None)]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(data)], "page_id long, url string, bad int")
    got = {r["url"]: r["verdict"] for r in rows(url_filters.judge(df, rules=(), label="bad"))}
    assert got["http://s.example/a/b/c/d/e/spam/999"] == "block" and got["http://s.example/a/b/c/d/e/news/999"] == "allow"


# ---- 5


def test_mixing(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows(mixing.mixed(docs, 1.5))
    seen = Counter(r["doc_id"] for r in got)
    size = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) or 1) for r in docs.collect()}
    assert set(seen) == set(size)
    have, spent, passes = Counter(), Counter(), {}
    for d, (s, n) in size.items():
        have[s] += n
        spent[s] += n * seen[d]
    for r in got:
        passes[r["source"]] = r["_passes"]
    assert max(passes.values()) == pytest.approx(1.5, abs=1e-6) and min(passes.values()) == pytest.approx(1.0)
    longest = max(n for _, n in size.values())
    for s in have:
        assert have[s] * passes[s] - 1e-6 <= spent[s] <= have[s] * passes[s] + longest
    assert sum({r["source"]: r["_weight"] for r in got}.values()) == pytest.approx(1)
    odd_rows = rows(mixing.mixed(odd, 2.0))
    assert {r["doc_id"] for r in odd_rows} == {r[0] for r in ODD}
    assert mixing.mixed(empty(odd)).count() == 0


def test_mixing_entropy(spark):
    import math

    src = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "s string, n_tokens long")
    a = mixing.exponent(src, target_entropy=0.8)
    q = [x**a for x in (0.9, 0.09, 0.01)]
    p = [x / sum(q) for x in q]
    assert -sum(x * math.log(x) for x in p) == pytest.approx(0.8, abs=1e-6)


# ---- columns of any name


NAMES = (
    "_row _t _w _l _h _g _s _at _d _k _i _doc _src _body _block _pass _order _spans _x _v _hit _said _text _key _n _r _fp shape shape2 host path rule verdict template bad_share spans items "
    "n_words n_tokens kept base_failed score lang_pred fps node root component_id text_key fingerprint row_number shard slot size said width h level"
).split()


def test_columns_of_any_name_pass_through(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", 1, 2)], "item_id long, text string, said string, h long")
    good = spark.createDataFrame([(50, " ".join(f"word{k} the" for k in range(30)), "en", "a")], "doc_id long, text string, lang string, source string")
    base = odd.select("doc_id", "text", "lang", "source").union(good).withColumn("url", F.lit("https://h.example/a/b"))
    for names in (NAMES, [n.upper() for n in NAMES]):
        df = base.withColumns({n: F.lit(f"own {n}") for n in names})
        stages = (quality.accepted(df), simhash.deduplicated(df), decontam.clean(df, bench), decontam.cut(df, bench), mixing.mixed(df), url_filters.judge(df), quality.judge(df), langid.predicted(df, {}))
        for k, out in enumerate(stages):
            got = out.collect()
            replaced = {*mixing.ADDED, *quality.MEASURES, "host", "path", "rule", "template", "bad_share", "verdict", "lang_pred", "score"} if k > 3 else set()
            assert got and len({c.lower() for c in out.columns}) == len(out.columns), k
            assert all(r[n] == f"own {n}" for r in got for n in names if n.lower() not in replaced), k
        assert simhash.grouped(df).count() == decontam.scan(df, bench).count() == sharding.sharded(df).count() == tokens.counts(df).count() == df.count()


# ---- 3


def test_chat(spark):
    calls = [
        (1, "a", "add", '{"x":1,"y":2}', 0), (1, "b", "add", '{"x":"one","y":2}', 1), (1, "c", "add", '{"y":2}', 2), (1, "d", "nope", "{}", 3),
        (1, "a", "add", '{"x":5,"y":6}', 4), (1, "e", "add", "not json", 5), (None, "n", "add", "{}", 0), (2, "p", "add", '{"x":1,"y":1}', 0), (2, "q", "add", '{"x":1,"y":1}', 1),
    ]
    results = [(1, "a", "3", 10), (1, "a", "11", 11), (1, "z", "?", 12), (2, "p", 'say "hi"\n\x01', 5), (1, "b", None, 0)]
    edges = [(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "d", "gone"), (2, "p", "q"), (2, "q", "p")]
    mk = spark.createDataFrame
    c = mk(calls, "conv_id long, call_id string, name string, arguments string, place long")
    r = mk(results, "conv_id long, call_id string, content string, place long")
    e = mk(edges, "conv_id long, call_id string, needs string")
    schema = {"add": {"x": ("integer", True), "y": ("integer", True)}}
    got = rows(chat.formatted(c, r, e, schema))
    assert len(got) == 10
    by = {(g["conv_id"], g["call_id"], g["call_place"]): g for g in got}
    assert by[1, "a", 0]["result_place"] == 10 and by[1, "a", 4]["result_place"] == 11
    assert [by[1, k, p]["level"] for k, p in (("a", 0), ("b", 1), ("c", 2), ("d", 3))] == [0, 1, 2, 0]
    assert by[2, "p", 0]["level"] is None and by[2, "q", 1]["level"] is None
    assert [by[1, k, p]["problems"] for k, p in (("a", 0), ("b", 1), ("c", 2), ("d", 3))] == [[], ["x is no integer"], ["missing x"], ["unknown tool"]]
    assert by[1, "e", 5]["problems"] == ["no JSON", "missing x", "missing y"]
    assert by[1, "z", None]["state"] == "orphan" and by[1, "b", 1]["state"] == "early" and by[2, "q", 1]["state"] == "pending"
    assert by[2, "p", 0]["json"] == '{"arguments":{"x":1,"y":1},"content":"say \\"hi\\"\\n\\u0001","id":"p","name":"add","state":"linked"}'
    assert rows(chat.formatted(empty(c), empty(r), empty(e), schema)) == []


def test_chat_embedded(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "hi"), (1, 1, "assistant", 'x <tool_call>{"id":"k","name":"respond","arguments":{"text":"t","turn":1},"needs":["j"]}</tool_call>'),
        (1, 2, "tool", '<tool_response>{"id":"k","content":"ok"}</tool_response>'), (None, None, None, None),
    ], "conv_id long, turn long, role string, text string")
    c, r, e = chat.embedded(turns)
    got = rows(chat.formatted(c, r, e))
    assert len(got) == 1 and got[0]["state"] == "linked" and got[0]["json"] == '{"arguments":{"text":"t","turn":1},"content":"ok","id":"k","name":"respond","state":"linked"}'


def test_chat_arguments_are_typed_and_canonical(spark):
    schema = {"t": {"i": ("integer", True), "s": ("string", False), "n": ("number", False), "b": ("boolean", False), "a": ("array", False), "o": ("object", False)}}
    given = [
        ('{ "s" : "x", "i": 1 }', [], '{"i":1,"s":"x"}'), ('{"i":1,"s":"x"}', [], '{"i":1,"s":"x"}'), ('"{\\"s\\":\\"x\\",\\"i\\":1}"', [], '{"i":1,"s":"x"}'),
        ('{"i":"1"}', ["i is no integer"], '{"i":"1"}'), ('{"i":1,"s":5}', ["s is no string"], '{"i":1,"s":5}'), ('{"i":1.5}', ["i is no integer"], '{"i":1.5}'),
        ('{"i":1,"n":2.50,"b":true,"a":[{"z":1,"y":null}],"o":{"q":{"d":1,"c":2}}}', [], '{"a":[{"y":null,"z":1}],"b":true,"i":1,"n":2.5,"o":{"q":{"c":2,"d":1}}}'),
        ('{"i":1,"a":{},"o":[]}', ["a is no array", "o is no object"], '{"a":{},"i":1,"o":[]}'), ('{"i":null}', ["i is no integer"], '{"i":null}'),
        ('{"i":1,"zz":2,"k":3}', ["unexpected k", "unexpected zz"], '{"i":1,"k":3,"zz":2}'), ("[1]", ["no object", "missing i"], "[1]"), ('{"i":1,"i":2}', ["no JSON", "missing i"], '"{\\"i\\":1,\\"i\\":2}"'),
        (None, ["no JSON", "missing i"], "null"), ("", ["no JSON", "missing i"], '""'),
    ]
    c = spark.createDataFrame([(1, f"c{k:02}", "t", g[0], k, "clash", "x") for k, g in enumerate(given)], "conv_id long, call_id string, name string, arguments string, place long, node string, level string")
    none = spark.createDataFrame([], "conv_id long, call_id string, content string, needs string, place long")
    got = sorted(rows(chat.formatted(c, none, none, schema)), key=lambda r: r["call_id"])
    for g, (_, bad, said) in zip(got, given, strict=True):
        assert g["problems"] == bad and g["json"].startswith('{"arguments":' + said + ',"id"'), g


def test_chat_levels_as_brute_force(spark):
    import random

    rnd = random.Random(3)
    edges = []
    for conv in range(40):
        n = rnd.randrange(2, 12)
        for _ in range(rnd.randrange(0, 2 * n)):
            a, b = rnd.sample(range(n), 2)
            edges.append((conv, str(max(a, b)), str(min(a, b))) if conv % 3 else (conv, str(a), str(b)))
        edges.append((conv, "0", "gone"))
    edges += [(50, str(k), str(k - d)) for k in range(3, 400) for d in (1, 2, 3)]  # each builds on the three before it
    edges += [(51, str(k), str(k - 1)) for k in range(1, 10_000)]
    names = {(c, x) for c, a, b in edges for x in (a, b) if x != "gone"} | {(c, str(k)) for c in range(40) for k in range(12)}
    needs = defaultdict(set)
    for c, a, b in edges:
        if (c, b) in names:
            needs[c, a].add((c, b))
    want, left = {}, set(names)
    while ready := {x for x in left if all(y in want for y in needs[x])}:
        for x in ready:
            want[x] = 1 + max((want[y] for y in needs[x]), default=-1)
        left -= ready
    calls = spark.createDataFrame([*names, (None, "x"), (7, None)], "conv_id long, call_id string")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in rows(chat.levels(calls, spark.createDataFrame(edges, "conv_id long, call_id string, needs string")))}
    assert got == {x: want.get(x) for x in names} and left and max(want.values()) == 9_999


def test_chat_repeated_and_null_identifiers(spark):
    c = spark.createDataFrame([(1, "a", "t", "{}", k) for k in range(50)] + [(1, None, "t", "{}", 0)] * 2 + [(None, "a", "t", "{}", 0)], "conv_id long, call_id string, name string, arguments string, place long")
    r = spark.createDataFrame([(1, "a", f"r{k}", 100 + k) for k in range(45)] + [(1, None, "n", 1), (None, None, None, None)], "conv_id long, call_id string, content string, place long")
    none = spark.createDataFrame([], "conv_id long, call_id string, needs string")
    got = rows(chat.formatted(c, r, none, {"t": {}}))
    assert Counter(g["state"] for g in got) == {"linked": 45, "pending": 8, "orphan": 2}
    assert all(g["result_place"] == g["call_place"] + 100 for g in got if g["state"] == "linked")


def test_chat_odd_turns(spark):
    turns = spark.createDataFrame([
        (1, 0, "system", "s", "x"), (1, 1, "user", "u" * 2_000_000, "x"), (1, 2, "assistant", "a", "x"), (1, 3, "user", None, "x"), (1, 3, "user", "again", "x"), (1, 5, "assistant", "b", "x"),
        (1, 6, None, "c", "x"), (1, None, "user", "d", "x"), (None, 0, "user", "e", "x"), (None, None, None, None, None), (1, 8, "tool", "", "x"),
    ], "conv_id long, turn long, role string, text string, call_id string")
    got = rows(chat.formatted(*chat.dialogue(turns)))
    assert len(got) == 10
    by = {(g["conv_id"], g["call_id"], g["call_place"] and g["call_place"]["turn"]): g for g in got}
    assert by[1, "turn:0", 0]["state"] == "pending" and by[1, "turn:0", 0]["level"] == 0
    assert by[1, "turn:1", 1]["state"] == "linked" and by[1, "turn:1", 1]["level"] == 1 and len(by[1, "turn:1", 1]["json"]) > 2_000_000
    assert by[1, "turn:3", 3]["level"] == 2 and by[1, "turn:4", None]["state"] == by[1, "turn:7", None]["state"] == "orphan"
    assert sorted(map(tuple, (g["problems"] for g in got if g["call_id"] == "turn:3"))) == [(), ("text is no string",)]
    assert by[1, "turn:6", 6]["problems"] == ["unknown tool"] and by[None, "turn:0", 0]["level"] is None


def test_chat_table(spark):
    got = rows(queries.op3_chat_formatting(spark, SF))
    turns = rows(spark.read.parquet(f"{SF}/conversations.parquet"))
    asked = sum(t["role"] != "assistant" for t in turns)
    assert sum(g["call_place"] >= 0 for g in got) == asked and sum(g["result_place"] >= 0 for g in got) == len(turns) - asked
    import json

    for g in got:
        j = json.loads(g["json"])
        assert list(j) == sorted(j) and g["json"] == json.dumps(j, ensure_ascii=False, separators=(",", ":"))
