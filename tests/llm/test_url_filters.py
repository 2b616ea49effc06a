from lexalloy.llm import url_filters as uf

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c in UPPER else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for kind, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "nothing", "http://", "://x", "http://A.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://org", "http://org/", "http://xorg/", "http://a.com/fr/", "http://a.com/de/x",
        "http://a.com?x=/de/", "http://a.com#://b.com/de/", "x://É.com/fr/é\nq", "http://a.net/de/1", "http://a.net/fr/1", "http://a.net/fr/1"]


def test_parts_and_rules_equal_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)]
    for r in uf.with_rule(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect():
        assert (r.host, r.path, r.rule, r.rule_verdict) == brute(URLS[r.page_id]), URLS[r.page_id]


def test_regression_generalises_from_rules(spark):
    rows = [(i, f"http://{'ab'[i % 2]}{i}.com/{('fr', 'de')[i % 2]}/{i}") for i in range(200)] + [(1000 + i, u) for i, u in enumerate(URLS)]
    out = {r.page_id: r for r in uf.filtered(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert len(out) == len(rows)
    assert out[1016].rule is None and out[1016].verdict == "block" and out[1017].verdict == "allow"
    assert all(r.verdict in ("allow", "block") for r in out.values())


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in uf.filtered(docs, RULES).collect()} == {"allow"}
    assert uf.filtered(docs.limit(0), RULES).count() == 0
    assert {r.verdict for r in uf.filtered(docs, (("block", "net/y"),), docs.selectExpr("'h' host", "'/p' path", "1.0 label")).collect()} == {"block"}


def test_regression_equals_a_plain_fit_and_holds_out(spark):
    import random
    import zlib

    import numpy as np

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(600):
        bad = i % 2
        path = "/" + "/".join(r.choice(["casino", "xxbet", "pills"] if bad else ["news", "science", "recipes"]) + word() for _ in range(2))
        rows.append((i, f"{word()}.net", path, float(bad)))
    train = spark.createDataFrame([x[1:] for x in rows if zlib.crc32(str(x[0]).encode()) % 4], "host string, path string, label double")
    urls = spark.createDataFrame([(i, f"https://{h}{p}") for i, h, p, _ in rows], "page_id long, url string")
    found = {x.page_id: x for x in uf.filtered(urls, (), labelled=train, features=256).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 0]
    right = sum((found[i].verdict == "block") == bool(y) for i, _, _, y in held)
    assert right >= 0.95 * len(held)

    # the same loss (mean log-loss and ridge on standardised columns) by plain gradient steps
    hashed = uf.HashingTF(numFeatures=256, binary=True, inputCol="g", outputCol="f")
    parts = urls.select("page_id", uf.host_of(uf.F.col("url")).alias("host"), uf.path_of(uf.F.col("url")).alias("path"))
    vectors = {x.page_id: x.f.toArray() for x in hashed.transform(parts.withColumn("g", uf.grams(uf.F.col("host"), uf.F.col("path"), (2, 3, 4)))).collect()}
    known = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4]
    x, y = np.array([vectors[i] for i, *_ in known]), np.array([k[3] for k in known])
    std = x.std(axis=0, ddof=1)
    z = np.where(std > 0, x / np.where(std > 0, std, 1), 0)
    w, b = np.zeros(256), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w, b = w - 0.05 * (z.T @ (p - y) / len(y) + 0.01 * w), b - 0.05 * (p - y).mean()
    want = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(want - [found[i].block_probability for i, *_ in known]).max() < 0.02


def test_ties_and_long_urls(spark):
    urls = spark.createDataFrame([(1, "http://a.b/x" + "y" * 50_000), (2, None), (3, "no host")], "page_id long, url string")
    found = {r.page_id: r for r in uf.filtered(urls, (("allow", "a.b/x"), ("block", "a.b/x"))).collect()}
    assert (found[1].rule, found[1].verdict, len(found[1].path)) == ("a.b/x", "block", 50_002)
    assert found[2].host == found[3].path == "" and found[2].rule is None
