"""Article merge order, BFS against brute force, MMR against brute force."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.operators import articles as Art
from newsflow.operators import frontier as Fr
from newsflow.operators import text as Tx

T0 = dt.datetime(2024, 2, 1)


def _results(spark, rows):
    data = [(loc, json.dumps(body), T0 + dt.timedelta(minutes=m)) for loc, body, m in rows]
    return spark.createDataFrame(data, schemas.RAW_RESULTS)


def _merge(spark, class_rows, summary_rows):
    base = spark.createDataFrame([(k, f"u{k}", f"t{k}", "s", None, None, None, None, None) for k in "abcd"],
                                 schemas.ARTICLES)
    tasks = spark.createDataFrame([(f"{k}-{t}", k, t) for k in "abcde" for t in ("classification", "summary")],
                                  schemas.INFERENCE_TASKS)
    out = Art.metadata_merge(base, _results(spark, class_rows), _results(spark, summary_rows), tasks)
    return {r["url_hash"]: (r["tags"], r["summary"], r["indexed_at"]) for r in out.collect()}


def test_merge_any_order_and_edges(spark):
    cls = [("a-classification", [{"label": "x", "score": 1.0}], 5),     # classification first
           ("b-classification", [{"label": "y", "score": 1.0}], 9),     # summary first
           ("d-classification", [{"label": "old", "score": 1.0}], 1),   # both twice: newest wins
           ("d-classification", [{"label": "new", "score": 1.0}], 2),
           ("e-classification", [{"label": "z", "score": 1.0}], 1)]     # unknown article: dropped
    summ = [("a-summary", [{"summary_text": "sa"}], 7), ("b-summary", [{"summary_text": "sb"}], 3),
            ("c-summary", [], 4)]                                       # empty result array: nothing
    got = _merge(spark, cls, summ)
    assert got["a"][:2] == (["x"], "sa") and got["a"][2] == T0 + dt.timedelta(minutes=7)
    assert got["b"][:2] == (["y"], "sb") and got["b"][2] == T0 + dt.timedelta(minutes=9)
    assert got["c"] == (None, None, None)
    assert got["d"][0] == ["new"]
    assert "e" not in got
    assert _merge(spark, list(reversed(cls)), list(reversed(summ))) == got


def test_upserts(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    upd = spark.createDataFrame([("a", 9, None, 1.0), ("a", 8, "z", 2.0), ("c", 3, "q", 1.0)],
                                "k string, v int, w string, o double")
    rep = {r["k"]: (r["v"], r["w"]) for r in Art.upsert_replace(base, upd, key="k", order_col="o").collect()}
    assert rep == {"a": (8, "z"), "b": (2, "y"), "c": (3, "q")}
    patch = spark.createDataFrame([("a", None), ("c", "n")], "k string, w string")
    mer = {r["k"]: (r["v"], r["w"]) for r in Art.upsert_merge(base, patch, key="k").collect()}
    assert mer == {"a": (1, "x"), "b": (2, "y"), "c": (None, "n")}
    twice = Art.upsert_merge(Art.upsert_merge(base, patch, key="k"), patch, key="k")
    assert {r["k"]: (r["v"], r["w"]) for r in twice.collect()} == mer        # idempotent


def brute_bfs(seeds, edges, seen, budget, aliases=()):
    """A queue per level; a redirect target of a visit is barred from the next level on."""
    md5 = lambda u: __import__("hashlib").md5(u.encode()).hexdigest()
    adj, final = {}, {}
    for s, d in edges:
        adj.setdefault(s, []).append(d)
    for u, f in aliases:
        final.setdefault(u, []).append(f)
    first = {}
    for tag, url, pos in sorted(seeds, key=lambda x: x[2]):
        first.setdefault(url, (tag, pos))
    level = {u: tp for u, tp in first.items() if u not in seen}
    barred, out, depth = set(seen), [], 0
    while level and (budget is None or len(out) < budget):
        rows = sorted(level.items(), key=lambda x: (x[1][1], md5(x[0])))
        rows = rows if budget is None else rows[:budget - len(out)]
        out += [(u, t, p, depth) for u, (t, p) in rows]
        barred |= set(level)
        barred |= {f for u in level for f in final.get(u, [])}
        nxt = {}
        for u, (t, p) in level.items():
            for v in adj.get(u, []):
                if v not in barred and (v not in nxt or (p, t) < (nxt[v][1], nxt[v][0])):
                    nxt[v] = (t, p)
        level, depth = nxt, depth + 1
    return sorted(out)


def _bfs(spark, seeds, edges, seen=None, budget=500, aliases=None, **kw):
    s = spark.createDataFrame(seeds, "tag string, url string, seed_pos int")
    e = spark.createDataFrame(edges, "src_url string, dst_url string")
    sn = al = None
    if seen:
        sn = spark.createDataFrame([(u,) for u in seen], "u string").select(F.md5("u").alias("url_hash"))
    if aliases:
        al = spark.createDataFrame(aliases, "url string, final_url string")
    out = Fr.bfs_frontier(s, e, sn, max_visits=budget, aliases=al, **kw)
    return sorted((r["url"], r["tag"], r["seed_pos"], r["depth"]) for r in out.collect())


def test_bfs_fixtures(spark):
    seeds = [("t0", "s0", 0), ("t1", "s1", 1), ("t0", "s0", 2)]         # repeated seed
    edges = [("s0", "a"), ("s1", "a"), ("a", "a"),                        # self-loop
             ("a", "b"), ("b", "s0"),                                     # cycle
             ("s1", "c"), ("c", "d"), ("a", "d"),                         # diamond: least seed wins
             ("x", "y")]                                                  # unreachable
    got = _bfs(spark, seeds, edges)
    assert got == brute_bfs(seeds, edges, set(), 500)
    assert ("d", "t0", 0, 2) in got and ("a", "t0", 0, 1) in got
    cut = _bfs(spark, seeds, edges, budget=3)                              # budget inside a level
    assert cut == brute_bfs(seeds, edges, set(), 3) and len(cut) == 3
    assert _bfs(spark, seeds, edges, seen=["a"]) == brute_bfs(seeds, edges, {"a"}, 500)
    assert _bfs(spark, seeds, edges, max_depth=1) == [r for r in got if r[3] <= 1]


def test_bfs_redirects(spark):
    seeds = [("t", "s", 0)]
    edges = [("s", "a"), ("s", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("d", "e2")]
    aliases = [("s", "a"), ("a", "d"), ("b", "b"), ("c", "e")]
    got = _bfs(spark, seeds, edges, aliases=aliases)
    # a is the seed's own target, d is a's (and a is never visited, so d is), e is c's
    assert got == brute_bfs(seeds, edges, set(), 500, aliases) == [("b", "t", 0, 1), ("d", "t", 0, 2), ("e2", "t", 0, 3), ("s", "t", 0, 0)]


def test_bfs_random_graphs(spark):
    rnd = random.Random(7)
    for n, levels in ((30, 3), (60, 8)):
        edges = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(n * 2)]
        seeds = [("ta", "n0", 0), ("tb", "n1", 1), ("tc", "n2", 2)]
        assert _bfs(spark, seeds, edges, budget=25, levels_per_job=levels) == brute_bfs(seeds, edges, set(), 25)
        aliases = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(n // 3)]
        assert _bfs(spark, seeds, edges, budget=None, aliases=aliases) == brute_bfs(seeds, edges, set(), None, aliases)


def brute_mmr(cands, top_n, diversity):
    cands = sorted(cands, key=lambda c: (-c[1], c[0]))
    best = max(s for _, s in cands)
    rel = [s / best for _, s in cands]
    toks = [set(g.split(" ")) for g, _ in cands]
    chosen, left = [], list(range(len(cands)))
    while left and len(chosen) < top_n:
        def score(i):
            sim = max((len(toks[i] & toks[j]) / len(toks[i] | toks[j]) for j in chosen), default=0.0)
            return (1 - diversity) * rel[i] - diversity * sim
        i = max(left, key=lambda i: (round(score(i), 12), -i))
        chosen.append(i)
        left.remove(i)
    return [cands[i][0] for i in chosen]


def test_mmr_against_brute_force(spark):
    docs = spark.createDataFrame(
        [(1, "apple banana apple cherry banana apple date apple banana fig grape apple kiwi lemon"),
         (2, "red blue red green blue red yellow red blue green orange purple red")],
        "doc_id long, text string")
    got = {}
    for r in Tx.keywords_mmr(docs, candidates=20, top_n=5, diversity=0.7).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append(r["gram"])
    cands = Tx.keywords_tfidf(docs, top_n=20).collect()
    for d in (1, 2):
        c = [(r["gram"], r["score"]) for r in cands if r["doc_id"] == d]
        assert got[d] == brute_mmr(c, 5, 0.7)


def test_levels_shuffle_neither_links_nor_visits(spark):
    """Each level: one join with the links, one anti join per known table, one
    exchange below them that carries (hash, mark), and no exchange on a table."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chain = spark.newSession()
    for k, v in (("adaptive.enabled", "false"), ("autoBroadcastJoinThreshold", "-1"), ("shuffle.partitions", str(buckets))):
        chain.conf.set(f"spark.sql.{k}", v)
    links, visits = Fr._Bucketed(chain, "t-links", "src_hash", buckets), Fr._Bucketed(chain, "t-visits", "url_hash", buckets, "job")
    one = spark.createDataFrame([("a", ["b"], [])], "src_hash string, dst_hashes array<string>, final_hashes array<string>")
    links.append(links.dealt(one))
    visits.append(visits.dealt(spark.createDataFrame([("a", 0, True, 0, True, 0)],
                                                     "url_hash string, seed long, visited boolean, depth int, fresh boolean, job int")))
    for steps in (1, 5):
        start = f"SELECT url_hash, seed AS mark, true AS fresh FROM {visits.name} WHERE job = 0"
        df = chain.sql(Fr.walk_sql(start, steps, links.name, [f"(SELECT url_hash FROM {visits.name} WHERE job > -1)"]))
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        kinds = [line.lstrip(" :+-*()0123456789").split(" ")[0] for line in lines]
        assert kinds.count("SortMergeJoin") == 2 * steps and kinds.count("Exchange") == steps
        scans = [i for i, k in enumerate(kinds) if k == "FileScan"]
        assert len(scans) == 2 * steps + 1
        depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-"))
        for i in scans[1:]:       # all but the start: nothing above them, up to their join, is an exchange
            above, now = [], depth(i)
            for j in range(i - 1, -1, -1):
                if depth(j) < now:
                    above.append(kinds[j])
                    now = depth(j)
                if above and above[-1] == "SortMergeJoin":
                    break
            assert "Exchange" not in above
    for t in (links, visits):
        t.drop()
