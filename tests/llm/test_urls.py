import random

from docloom.llm import urls


def judge(spark, pages, labels=()):
    p = spark.createDataFrame([(i, u, "x") for i, u in pages], "page_id long, url string, host string")
    lab = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {r.page_id: r for r in urls.url_filter(p, lab).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        "https://A.Example.COM/en/8x?q#f": ("a.example.com", "/en/8x", "com/en/", "block"),
        "http://example.com/en/70": ("example.com", "/en/70", "example.com/en/7", "allow"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
        "http://m.example.net/de/8#a": ("m.example.net", "/de/8", "example.net/de/8", "block"),
        "http://x.org/es": ("x.org", "/es", None, "allow"),
        "http://x.org/es/": ("x.org", "/es/", "org/es/", "block"),
        "//x.org/es/": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://x.fr?u=/en/": ("x.fr", "", None, "allow"),
        "http://É.com/en/1\n2": ("É.com", "/en/1\n2", "com/en/", "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    got = judge(spark, list(enumerate(cases)))
    for i, (u, want) in enumerate(cases.items()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, u


def test_bad_templates_are_rejected_and_similar_branches_merge(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for i in range(600):
        section = ["spam", "news", "blog"][i % 3]
        pages.append((i, f"http://h.fr/{section}/{i}"))
        if rng.random() < 0.8:
            labels.append((i, int(section != "spam" or rng.random() < 0.1), 0))
    got = judge(spark, pages, labels)
    assert all((got[i].verdict == "block") == (i % 3 == 0) for i in range(600))
    assert {got[0].template} == {"/spam/*"}


def test_toxic_and_repeated_labels_and_repeated_rows(spark):
    pages = [(i % 50, f"http://h.fr/t/{i % 50}") for i in range(100)]
    labels = [(i, 1, 1) for i in range(50)] + [(i, 1, 0) for i in range(50)] + [(None, 1, 0)]
    p = spark.createDataFrame([(i, u) for i, u in pages], "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.url_filter(p, lab).collect()
    assert len(got) == 100 and {r.verdict for r in got} == {"block"}
    assert urls.url_filter(p.limit(0), lab).count() == 0


def test_sql(same_as_sql):
    for name, sql in urls.ORACLES.items():
        same_as_sql(urls.QUERIES[name], sql)


def test_a_bad_branch_at_level_eight_equals_deeper_sql(spark, write, monkeypatch):
    import duckdb

    rng, pages, labels = random.Random(2), [], []
    for i in range(900):
        section = ["spam", "news", "blog"][i % 3]
        pages.append((i, f"http://h.fr/a/b/c/d/e/f/g/{section}/{i}" if i < 600 else f"http://h.fr/a/b/c/d/e/f/g/{section}/x/{i}"))
        labels.append((i, int(section != "spam" or rng.random() < 0.1), 0))
    pages += [(900, "http://h.fr/" + "z/" * 9), (901, "http://h.fr/a/b/c"), (902, "http://k.fr/1/2/3/4/5/6/7/8")]
    got = judge(spark, pages, labels)
    assert all((got[i].verdict == "block") == (i % 3 == 0) for i in range(900))
    assert got[0].template != got[600].template and got[900].template == "/*" * 9
    monkeypatch.setattr(urls, "DEPTH", 12)
    con = duckdb.connect()
    for name, rows, schema in (("pages", pages, "page_id long, url string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        folder = write(spark.createDataFrame(rows, schema), name)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    want = con.sql(urls.oracle()).df()
    assert {(i, r.verdict, r.template) for i, r in got.items()} == set(zip(want.page_id, want.verdict, want.template, strict=True))


def test_very_deep_paths_end_with_few_labels(spark):
    got = judge(spark, [(i, "http://h.fr/" + "/".join(f"s{k}" for k in range(300 + i))) for i in range(3)], [(i, 0, 0) for i in range(3)])
    assert {i: r.template.count("/*") for i, r in got.items()} == {0: 300, 1: 301, 2: 302}
