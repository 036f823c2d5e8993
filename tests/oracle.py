"""Compare a registered query with its SQL, as unordered rows with rounded floats."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings rnadisease website_alldata diseases_textmined doid_terms hgnc_complete_set lncrna_seq raw_submissions eval_items moderation_labels".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    extra, missing = got[1] - want[1], want[1] - got[1]
    assert not extra and not missing, f"{sum(got[1].values())} rows, {sum(want[1].values())} wanted; extra {list(extra)[:3]}; missing {list(missing)[:3]}"
    return sum(got[1].values())
