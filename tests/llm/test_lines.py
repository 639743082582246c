from pyspark.sql import functions as F

from lexigrid.llm import lines as L

SCHEMA = "page_id long, url string, html string, host string, lines string, keys string, kept string, pages int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "l", "k", "old", 1) for i, u, h in rows], SCHEMA)


def run(df, **k):
    return L.clean(df, L.html_lines(F.col("html")), L.url_host(F.col("url")), **k)


def brute(rows, ratio, least):
    import re

    def split(h):
        return [x.strip(" ") for x in re.split(L.TAGS, h or "") if x.strip(" ")] if h is not None else None

    def host(u):
        if u is None:
            return None
        rest = u.split("//", 1)[1] if re.match(r"([a-zA-Z][\w+.-]*:)?//", u) else u if re.match(r"[\w-]+(\.[\w-]+)+(:\d+)?([/?#]|$)", u) else ""
        return re.split("[/?#]", rest)[0].split("@")[-1].lower() or None

    total, seen = {}, {}
    for _, u, h in rows:
        if host(u) is not None:
            total[host(u)] = total.get(host(u), 0) + 1
            for x in set(split(h) or ()):
                seen[host(u), x] = seen.get((host(u), x), 0) + 1
    out = []
    for i, u, h in rows:
        ls = split(h)
        keep = None if ls is None else [x for x in ls if host(u) is None or not (seen[host(u), x] >= least and seen[host(u), x] > ratio * total[host(u)])]
        out.append((i, keep, 0 if ls is None else len(ls) - len(keep)))
    return sorted(out, key=repr)


ROWS = [
    *((i, f"http://one.example/{i}", f"<p>menu</p><p>text {i}</p><script>x<1</script><p>menu</p> {'half' if i % 2 else ''}") for i in range(20)),
    *((100 + i, f"https://two.example/{i}", f"<b>menu</b>rare {i % 4}<!-- c <b> -->") for i in range(8)),
    (200, None, "<p>menu</p>"), (201, "http://one.example/", None), (202, "no url", "<p>a</p>"), (203, "http://one.example/q", ""), (None, "http://one.example/z", "menu"),
    (0, "http://one.example/0", "<p>menu</p><p>text 0</p>"), (0, "http://one.example/0", "<p>menu</p><p>text 0</p>"), (300, "http://three.example", "long " * 50_000 + "<p>é 漢</p>"),
]


def test_against_brute_force(spark):
    for ratio, least in ((0.1, 3), (0.5, 1), (0.25, 2), (0.0, 1), (1.0, 1)):
        got = run(pages(spark, ROWS), ratio=ratio, least_pages=least)
        assert sorted(((r.page_id, r.kept, r.n_dropped) for r in got.collect()), key=repr) == brute(ROWS, ratio, least)


def test_hosts(spark):
    want = {
        "http://A.example/x": "a.example", "example.com/a": "example.com", "Example.com": "example.com", "//b.example?q": "b.example", "https://u:p@c.example:81/": "c.example:81",
        "no url": None, "": None, "http:///x": None, "mailto:a@b.example": None, None: None,
    }
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", L.url_host(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in got} == want


def test_urls_without_a_host_are_no_site(spark):
    assert {r.n_dropped for r in run(pages(spark, [(i, "no url", "<p>same</p>") for i in range(9)])).collect()} == {0}


def test_a_line_at_the_ratio_stays(spark):
    rows = [(i, "http://a.example", "x" if i < 5 else f"y{i}") for i in range(10)]
    assert {r.n_dropped for r in run(pages(spark, rows), ratio=0.5).collect()} == {0}
    assert sum(r.n_dropped for r in run(pages(spark, rows), ratio=0.49).collect()) == 5


def test_columns_and_empty_table(spark):
    df = pages(spark, [])
    got = run(df)
    assert got.columns == [*[c for c in df.columns if c != "kept"], "kept", "n_dropped"] and got.count() == 0


def test_plain_text(spark):
    docs = spark.createDataFrame([(i, "site", f"head\nbody {i}\n\n foot ") for i in range(5)], "doc_id int, source string, text string")
    got = L.clean(docs, L.text_lines(F.col("text")), F.col("source"))
    assert [r.kept for r in got.orderBy("doc_id").collect()] == [[f"body {i}"] for i in range(5)]
