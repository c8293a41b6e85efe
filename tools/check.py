"""Compare named queries with their SQL on one scale (development aid)."""
import sys, time, math
import duckdb
sys.path.insert(0, "/root/repo")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v): return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)): return tuple(norm(x) for x in v)
    if hasattr(v, "item"): return norm(v.item())
    return v


def compare(got, gcols, want, wcols):
    if sorted(gcols) != sorted(wcols):
        return f"columns {sorted(gcols)} vs {sorted(wcols)}"
    cols = sorted(gcols)
    gi, wi = [gcols.index(c) for c in cols], [wcols.index(c) for c in cols]
    key = lambda r: tuple(repr(x) for x in r)
    g = sorted((tuple(norm(r[i]) for i in gi) for r in got), key=key)
    w = sorted((tuple(norm(r[i]) for i in wi) for r in want), key=key)
    if len(g) != len(w): return f"rows {len(g)} vs {len(w)}"
    diff = [(a, b) for a, b in zip(g, w) if a != b]
    types = {c: {type(a[i]).__name__ for a in g[:200]} ^ {type(a[i]).__name__ for a in w[:200]} for i, c in enumerate(cols)}
    types = {c: v for c, v in types.items() if v}
    if diff: return f"{len(diff)} differ of {len(g)} {cols}: {diff[:3]}"
    if types: return f"types {types}"
    return None


if __name__ == "__main__":
    from tonegrid.session import local_session
    from tonegrid import plans
    sf = sys.argv[1]; pats = sys.argv[2:]
    spark = local_session("8"); spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES: con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    qs, sqls = plans.queries(), plans.oracle_sql()
    bad = 0
    for n in qs:
        if pats and not any(n.startswith(p) for p in pats): continue
        t0 = time.time()
        try:
            df = qs[n](spark, d); got = [tuple(r) for r in df.collect()]
        except Exception as e:
            bad += 1; print("FAIL", n, str(e)[:700]); continue
        dt = time.time() - t0
        if n not in sqls:
            print(f"rows {n} {len(got)} {dt:.1f}s", got[0] if got else ""); continue
        t1 = time.time()
        try:
            cur = con.execute(sqls[n]); wc = [c[0] for c in cur.description]; want = cur.fetchall()
        except Exception as e:
            bad += 1; print("SQLFAIL", n, str(e)[:500]); continue
        r = compare(got, df.columns, want, wc)
        if r or not got: bad += 1
        print("ok  " if not r else "DIFF", n, len(got), f"{dt:.1f}s sql {time.time()-t1:.1f}s", r or "")
    print("bad", bad)
