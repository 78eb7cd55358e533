"""URL filter, line dedup and mixing on odd rows, against plain Python."""

import re

from loanlens.llm import line_dedup, mixing, url_filter

URLS = [None, "", "no scheme", "://", "http://", "http://a.net", "http://a.net/es/", "HTTP://A.NET/es/x?y=/fr/", "https://net/fr/1", "https://xnet/fr/1", "https://www.Example.com/en/a#b", "https://b.www.example.com/en/",
        "https://example.com/en", "https://example.com/en/", "ftp://example.com/other", "http://foo.org/a.net/es/x", "http://spam.org/x", "http://SPAM.org", "http://my-casino.org?x=1", "http://pills.org#top", "http://x.org/spam/", "http://é.com/ü", "http://e.com:80/en/", "http://a://b.net/es/", "http://" + "l" * 300 + ".net/es/" + "p" * 500]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for v, r in url_filter.RULES for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    bad = not host or re.search("spam|pills|casino", host)
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[6], "x"), (6, URLS[6], "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = [tuple(r) for r in url_filter.url_filter(frame).collect()]
    assert sorted(got, key=str) == sorted(((k, *judged(u)) for k, u, _ in rows), key=str)
    assert url_filter.url_filter(frame.limit(0)).count() == 0
    other = {(r.host, r.verdict) for r in url_filter.url_filter(frame, globs=["foo.*/**"]).collect() if r.rule is None and r.host}
    assert ("foo.org", "block") in other and ("spam.org", "allow") in other


def test_automaton_over_several_words():
    import numpy as np

    globs = ["a*b", "*.net/**", "abc", "**z", "*" + "x" * 70 + "**", ""]
    texts = [b"", b"ab", b"a/b", b"aqqb", b"abc", b"q.net/a/b", b"q.net", b"a/z", b"y" + b"x" * 71 + b"/", b"x" * 69]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = url_filter.Automaton.compile(globs).run(np.frombuffer(b"".join(texts), np.uint8), offsets)
    pattern = [re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", g)).encode(), re.S) for g in globs]
    assert got.tolist() == [[bool(p.fullmatch(t)) for p in pattern] for t in texts]


def test_lines(spark):
    head = "shared head"
    rows = [(i, f"{head}\nline {i}\n\n  \nline {i}", "a") for i in range(8)] + [(20, None, "a"), (21, "", "a"), (22, head, "a"), (23, "\n", "a")]
    rows += [(30 + i, f"{head}\nown {i}", "b") for i in range(4)] + [(40 + i, "null head\nx", None) for i in range(6)] + [(40, "null head\nx", None)]
    frame = spark.createDataFrame([r + ("y",) for r in rows], "doc_id long, text string, source string, host string")
    got = sorted(((r.doc_id, r.text, r.line_dedup.n_lines, r.line_dedup.n_dropped) for r in line_dedup.line_dedup(frame).collect()), key=str)
    want = []
    for k, t, s, in rows:
        lines = [] if t is None else t.split("\n")
        pages = [x for x in rows if x[2] == s]
        bad = {x for x in lines if x.strip(" ") and (n := sum(x in (p[1] or "").split("\n") for p in pages)) >= 5 and n / len(pages) > 0.1}
        left = [x for x in lines if x not in bad]
        want.append((k, None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    assert got == sorted(want, key=str)
    assert line_dedup.line_dedup(frame).columns == [*frame.columns, "line_dedup"]
    assert line_dedup.line_dedup(frame.limit(0)).count() == 0


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(sizes.values()), {}
    open_ = set(order)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ -= over or open_
    return target


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), ["b", "a", None, "é", ""][i % 5 if i % 3 else 0]) for i in range(300)]
    rows += [(400, None, "a"), (401, "", "zero"), (402, " one ", "one"), (7, "again a row", "a"), (7, "again a row", "a"), (None, "null key", "a"), (None, "null key", "a")]
    frame = spark.createDataFrame([r + (1,) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    sizes, want = {}, {}
    for k, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)

    def taken():
        mix = mixing.plan(frame)
        return mix, mixing.schedule(mix)

    mix, slots = taken()
    by_source = {r.source: r.target for r in mix.sources.collect()}
    assert by_source.keys() == want.keys() and all(abs(by_source[s] - want[s]) < 1e-6 for s in want)
    names = {r._src: r.source for r in mix.sources.collect()}
    pieces = slots.collect()
    got, of_doc = {}, {}
    for r in pieces:
        got[names[r._src]] = got.get(names[r._src], 0) + r.words
        of_doc[r._src, r.start] = of_doc.get((r._src, r.start), 0) + r.words
        assert of_doc[r._src, r.start] <= 2 * r.size
    assert all(abs(got.get(s, 0) - want[s]) <= 3 for s in want)
    assert sorted(pieces) == sorted(taken()[1].collect())
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    n = sum(len(r.text.split()) for r in out.collect())
    assert n == sum(got.values())
    assert mixing.mixed(frame.limit(0)).count() == 0


def test_few_slots(spark):
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(200)]
    mix = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=500)
    assert mix.block == 30
    got = {r._src: r.w for r in mixing.schedule(mix).groupBy("_src").agg({"words": "sum"}).withColumnRenamed("sum(words)", "w").collect()}
    assert all(abs(got[r._src] - r.target) <= 4 * mix.block for r in mix.sources.collect())


def test_small_sources_beside_a_hot_one(spark):
    # as at 30 GB: many sources of less than a block, and one of most words
    rows = [(i, "w " * 1500, "hot") for i in range(1000)] + [(10_000 + i, "w " * (1 + i % 90), f"tiny{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.plan(frame, slots=200)
    assert mix.block == mixing.BLOCK and mix.slots.count() > 200 * 20
    got = {r._src: r.w for r in mixing.schedule(mix).groupBy("_src").agg({"words": "sum"}).withColumnRenamed("sum(words)", "w").collect()}
    assert all(abs(got.get(r._src, 0) - r.target) <= 0.5 for r in mix.sources.collect())
    slots = [(r.slot, r._src, r.length) for r in mix.slots.orderBy("slot").collect()]
    assert [s for s, _, _ in slots] == list(range(len(slots)))
    total, hot = sum(n for _, _, n in slots), sum(n for _, s, n in slots if s == "=hot")
    half = slots[: len(slots) // 2]  # spread over the schedule, not served in one run
    assert abs(sum(n for _, s, n in half if s == "=hot") / hot - 0.5) < 0.05 and abs(sum(n for _, s, n in half if s != "=hot") / (total - hot) - 0.5) < 0.05
    assert {r.source for r in mixing.mixed(frame).select("source").distinct().collect()} == {s for _, _, s in rows}
