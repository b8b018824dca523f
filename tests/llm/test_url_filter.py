import re
from collections import defaultdict

from tessella.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string"


def brute(rows):
    pages = []
    for i, u, h, *_ in rows:
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[2].translate({k: k + 32 for k in range(65, 91)}), m[3]) if m else ("", "")
        fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        pages.append((i, host, path, max(fit, key=lambda r: len(r.name)) if fit else None, h))
    seen, seeds = defaultdict(list), {}
    for _, host, _, r, _ in pages:
        seen[host].append(r.verdict if r else "")
    edges = {(a, b.lower()) for _, a, _, _, h in pages for b in re.findall(U.LINK, h or "") if a and a != b.lower()}
    score = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        arcs = edges if kind == "trust" else {(b, a) for a, b in edges}
        out = defaultdict(list)
        for a, b in arcs:
            out[a].append(b)
        start = {h: v.count(verdict) / len(v) for h, v in seen.items() if h and 2 * v.count(verdict) >= len(v)}
        unit = sum(start.values())
        state = start = {h: w / unit for h, w in start.items()}
        for _ in range(200):
            new = defaultdict(float)
            for a, x in state.items():
                for b in out[a]:
                    new[b] += 0.85 * x / len(out[a])
            rest = 1 - sum(new.values())
            for h, w in start.items():
                new[h] += rest * w
            state = new
        assert abs(sum(state.values()) - 1) < 1e-9
        score[kind] = defaultdict(float, {h: x * unit for h, x in state.items()})
    bad = lambda h: score["distrust"][h] >= max(U.FLOOR, score["trust"][h])
    return sorted((i, h, p, r.name if r else None, r.verdict if r else "block" if bad(h) else "allow") for i, h, p, r, _ in pages)


def test_against_brute_force(spark):
    spam = '<a href="http://bad.example.net/es/1">x</a><a href=HTTPS://Worse.example.net/q>y</a>'
    rows = [
        (1, "http://WWW.Example.com/en/x?q#f", None), (2, "https://blog.example.com/en/", ""), (3, "http://a.com", "x"), (4, "http://a.com/", spam),
        (5, "http://bad.example.net/es/1", '<a href="//farm.org/">'), (6, "http://bad.example.net/fr/1", spam), (7, None, spam), (8, "no scheme", spam),
        (9, "http://farm.org/p", spam), (10, "http://farm.org/q?http://x", spam), (11, "http://fine.org/p", '<a href="http://a.com/">'), (12, "x://y://z/a", ""),
        (13, "http://worse.example.net/es/1", ""), (14, "http://worse.example.net/fr/", ""), (15, "http://notexample.com/en/", ""), (16, "http://net/es/a", ""),
        (17, "http://é.org/é", "é"), (17, "http://é.org/é", "é"), (18, "http://far.org/" + "x" * 50_000, '<a href="http://farm.org/">' * 1000),
    ]
    rows = [(*r, "clash") for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judged_urls(df).collect())
    assert got == brute(rows)
    assert [r[4] for r in got if r[0] in (9, 10)] == ["block", "block"]


def test_linkers_of_a_popular_blocked_host(spark):
    """Forty hosts link to one blocked host: those that nobody trusts are blocked, those that a trusted host links to aren't."""
    hub = '<a href="http://hub.net/x">'
    rows = [(0, "http://hub.net/es/1", "", "x"), *((i, f"http://h{i}.org/", hub, "x") for i in range(1, 41))]
    rows.append((99, "http://good.com/", "".join(f'<a href="//h{i}.org/">' for i in range(1, 11)), "x"))
    got = {r.page_id: r.verdict for r in U.judged_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "block", 99: "allow"} | {i: "allow" if i <= 10 else "block" for i in range(1, 41)}
    assert sorted(got.items()) == [(r[0], r[4]) for r in brute(rows)]


def test_empty(spark):
    assert U.judged_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_without_any_seed(spark):
    rows = [(1, "http://a.org/", "<a href=http://b.org/>", ""), (2, "http://b.org/", "<a href='//a.org/x'>", "")]
    out = U.judged_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id, r.host, r.rule, r.verdict, r.trust, r.distrust) for r in out) == [(1, "a.org", None, "allow", 0.0, 0.0), (2, "b.org", None, "allow", 0.0, 0.0)]


def test_rounds_move_ranks_not_arcs(spark, monkeypatch):
    """A round exchanges less than the arcs; a hub's arcs lie in several parts; ranks are those of brute force."""
    monkeypatch.setattr(U, "HUB", 50, raising=False)
    links = {(f"h{i}", f"h{(i * i + 7 * j) % 300}") for i in range(300) for j in range(60)} | {("h1", f"h{j}") for j in range(300)}
    arcs = spark.createDataFrame([(kind, *x) for kind in ("trust", "other") for x in links] + [("trust", None, "h1"), ("trust", "h2", None)], "kind string, src string, dst string")
    seeds = spark.createDataFrame([("trust", "h1", 1.0), ("trust", "alone", 3.0)], "kind string, host string, weight double")
    store = spark.sparkContext._jsc.sc()

    def exchanged():
        store.listenerBus().waitUntilEmpty()
        return sum(store.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(store.statusStore().executorList(False).size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = [exchanged()]
        for rounds in (2, 12):
            got = {(r.kind, r.host): r.rank for r in U.propagate(arcs, seeds, tolerance=-1.0, rounds=rounds).collect()}
            at.append(exchanged())
        arcs.where("kind = 'trust'").repartition(8, "kind", "src").write.format("noop").mode("overwrite").save()
        once = exchanged() - at[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out = defaultdict(list)
    for a, b in [*links, ("h2", None)]:
        out[a].append(b)
    state = start = {"h1": 0.25, "alone": 0.75}
    for _ in range(12):
        new = defaultdict(float)
        for a, x in state.items():
            for b in out[a]:
                new[b] += 0.85 * x / len(out[a])
        rest = 1 - sum(new.values())
        state = {h: new[h] + rest * start.get(h, 0.0) for h in {*new, *start}}
    assert got.keys() == {("trust", h) for h in state}
    assert max(abs(got["trust", h] - x) for h, x in state.items()) < 1e-12
    assert (at[2] - at[1]) - (at[1] - at[0]) < 10 * once
