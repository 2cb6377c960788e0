"""M7: clustering over ``embeddings`` (buckets from ``documents.lang``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import density as D
from quarry.operators import graph as G
from quarry.operators import kmeans as K
from quarry.plans.registry import register, rounded
from quarry.session import materialize
from quarry.sources.tables import embeddings, table

EPS_COS = 0.35  # fixture cut: cosine >= 0.35 links two samples


def _sqdist_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@register("kmeans_step", operators=("CLU-1",), sql=f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
init AS (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster_id, v AS c FROM (
    SELECT v, md5('42:' || CAST(vec_id AS VARCHAR)) AS h FROM e
    ORDER BY h LIMIT 5) t),
d AS (SELECT e.vec_id, init.cluster_id, {_sqdist_sql('e.v', 'init.c')} AS sq FROM e, init),
a AS (SELECT vec_id, cluster_id AS cluster, sq AS sq_dist FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sq, cluster_id) AS rk FROM d) t
      WHERE rk = 1)
SELECT vec_id, cluster, CAST(round(sq_dist, 6) AS DOUBLE) AS sq_dist FROM a""")
def q_kmeans_step(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    cents = K.seeded_centroids(e, "vec_id", "embedding", 5, seed=42)
    a, _ = K.kmeans_step(e, cents, "embedding")
    return rounded(a.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "sq_dist"))


@register("kmeans_update", operators=("CLU-1", "AGG-9"), sql=f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
init AS (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster_id, v AS c FROM (
    SELECT v, md5('42:' || CAST(vec_id AS VARCHAR)) AS h FROM e
    ORDER BY h LIMIT 5) t),
d AS (SELECT e.vec_id, e.v, init.cluster_id, {_sqdist_sql('e.v', 'init.c')} AS sq FROM e, init),
a AS (SELECT vec_id, v, cluster_id FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sq, cluster_id) AS rk FROM d) t
      WHERE rk = 1),
m AS (SELECT cluster_id, pos, avg(x) AS m, count(*) AS n FROM (
        SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a) t
      GROUP BY cluster_id, pos)
SELECT cluster_id, CAST(pos - 1 AS BIGINT) AS dim, CAST(round(m, 6) AS DOUBLE) AS value, n
FROM m""")
def q_kmeans_update(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    cents = K.seeded_centroids(e, "vec_id", "embedding", 5, seed=42)
    _, new = K.kmeans_step(e, cents, "embedding")
    return rounded(new.select(F.col("cluster_id").cast("int").alias("cluster_id"),
                              F.posexplode("centroid").alias("dim", "value"), "n")
                   .withColumn("dim", F.col("dim").cast("long")))


@register("kmeans", operators=("CLU-1",))
def q_kmeans(spark, sf_dir):
    """MLlib KMeans k=5, seed 42 (labels depend on the initialisation, so
    tests check partition properties, not label values)."""
    out, _ = K.kmeans(embeddings(spark, sf_dir), "embedding", k=5, seed=42)
    return out.select("vec_id", "label", "cluster")


def _lloyd_sql(rounds: int) -> str:
    """Rounds of assignment and update, one pair of tables a round."""
    parts = ["e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
             "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster_id, v AS c FROM ("
             "SELECT v, md5('42:' || CAST(vec_id AS VARCHAR)) AS h FROM e ORDER BY h LIMIT 5) t)"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT e.vec_id, e.v, arg_min(cluster_id, (sq, cluster_id)) AS cluster, min(sq) AS sq_dist "
                     f"FROM (SELECT e.vec_id, c{r}.cluster_id, {_sqdist_sql('e.v', f'c{r}.c')} AS sq FROM e, c{r}) d "
                     "JOIN e USING (vec_id) GROUP BY e.vec_id, e.v)")
        if r < rounds:
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster AS cluster_id, list(m ORDER BY pos) AS c FROM ("
                         f"SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) t "
                         "GROUP BY cluster, pos) u GROUP BY cluster)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, CAST(round(sq_dist, 6) AS DOUBLE) AS sq_dist FROM a{rounds}"""


@register("kmeans_lloyd", operators=("CLU-1", "AGG-9"), sql=_lloyd_sql(10))
def q_kmeans_lloyd(spark, sf_dir):
    """Ten Lloyd rounds from five hash-ordered seeds."""
    e = materialize(embeddings(spark, sf_dir))
    rows, _ = K.lloyd(e, K.seeded_centroids(e, "vec_id", "embedding", 5, seed=42), "embedding", 10)
    return rounded(rows.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "sq_dist"))


@register("eps_components", operators=("CLU-3", "JOIN-5"), sql=f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ed AS (SELECT a.vec_id AS s, b.vec_id AS t FROM e a JOIN e b ON a.vec_id < b.vec_id
       WHERE (CASE WHEN sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) > 0
                   THEN list_dot_product(a.v, b.v)
                        / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))
                   ELSE 0.0 END) >= {EPS_COS}),
und AS (SELECT s, t FROM ed UNION ALL SELECT t, s FROM ed),
cc(node, comp) AS (
  SELECT vec_id, vec_id FROM e
  UNION
  SELECT und.t, cc.comp FROM cc JOIN und ON und.s = cc.node)
SELECT node AS vec_id, min(comp) AS comp FROM cc GROUP BY node""")
def q_eps_components(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    edges = G.similarity_edges(e, "vec_id", "embedding", EPS_COS, forest=True)
    return G.components(e.select(F.col("vec_id").alias("id")), edges, "id").select(
        F.col("id").alias("vec_id"), "comp")


def _bucketed(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"),
                                                 F.col("lang").alias("bucket"))
    return e.join(d, "vec_id")


# Prim's algorithm as a recursive CTE: per bucket the state is the key and
# parent arrays (O(n d) per step); with distinct distances the MST is unique,
# so the edge sets must agree.
_PRIM_SQL = """WITH RECURSIVE pts AS (
  SELECT d.lang AS bucket, e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
b AS (SELECT bucket, list(id ORDER BY id) AS ids, list(v ORDER BY id) AS vs, count(*) AS n
      FROM pts GROUP BY bucket HAVING count(*) >= 2),
prim(bucket, ids, vs, n, inq, kk, par, eu, ev, ed, step) AS (
  SELECT bucket, ids, vs, n,
    list_transform(ids, lambda x, i: i = 1),
    list_transform(vs, lambda x, i: CASE WHEN i = 1 THEN CAST('Infinity' AS DOUBLE) ELSE
      sqrt(list_sum(list_transform(list_zip(x, vs[1]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END),
    list_transform(ids, lambda x, i: 1),
    CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 0
  FROM b
  UNION ALL
  SELECT bucket, ids, vs, n,
    list_transform(inq, lambda q, i: q OR i = j),
    list_transform(kk, lambda k, i: CASE WHEN inq[i] OR i = j THEN k ELSE least(k,
      sqrt(list_sum(list_transform(list_zip(vs[i], vs[j]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) END),
    list_transform(par, lambda q, i: CASE WHEN inq[i] OR i = j THEN q
      WHEN sqrt(list_sum(list_transform(list_zip(vs[i], vs[j]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) < kk[i]
      THEN j ELSE q END),
    least(ids[j], ids[par[j]]), greatest(ids[j], ids[par[j]]), kk[j], step + 1
  FROM (SELECT *, list_position(
          list_transform(kk, lambda k, i: CASE WHEN inq[i] THEN CAST('Infinity' AS DOUBLE) ELSE k END),
          list_min(list_transform(kk, lambda k, i: CASE WHEN inq[i] THEN CAST('Infinity' AS DOUBLE) ELSE k END))) AS j
        FROM prim WHERE step < n - 1) p)
SELECT bucket, eu AS u, ev AS v, CAST(round(ed, 6) AS DOUBLE) AS d FROM prim WHERE step > 0
"""


@register("euclidean_mst", operators=("CLU-2",), sql=_PRIM_SQL)
def q_euclidean_mst(spark, sf_dir):
    """Per-bucket exact Euclidean MST (Boruvka on tile blocks)."""
    return rounded(D.euclidean_mst(_bucketed(spark, sf_dir), "vec_id", "embedding", "bucket"))


# Kruskal over the same edges, one edge a step: the state is the tree node that
# every point lies in.  The condensed tree, stabilities, the excess-of-mass sums
# (children before parents) and the labels (parents first) are recursions too.
_DENSITY_SQL = _PRIM_SQL[:_PRIM_SQL.rindex("SELECT bucket, eu AS u")].rstrip() + """,
e AS MATERIALIZED (SELECT bucket, eu AS u, ev AS v, ed AS d, row_number() OVER (PARTITION BY bucket ORDER BY ed, eu, ev) AS r
      FROM prim WHERE step > 0 AND n >= 25),
kr(bucket, ids, comp, r, lft, rgt, nl, nr, d) AS (
  SELECT bucket, ids, list_transform(ids, lambda x, i: -i::BIGINT), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::DOUBLE
  FROM b WHERE n >= 25
  UNION ALL
  SELECT bucket, ids, list_transform(comp, lambda x: CASE WHEN x = a OR x = c THEN nxt ELSE x END), nxt, a, c,
         len(list_filter(comp, lambda x: x = a))::BIGINT, len(list_filter(comp, lambda x: x = c))::BIGINT, ed
  FROM (SELECT kr.bucket, kr.ids, kr.comp, e.r AS nxt, e.d AS ed,
               kr.comp[list_position(kr.ids, e.u)] AS a, kr.comp[list_position(kr.ids, e.v)] AS c
        FROM kr JOIN e ON e.bucket IS NOT DISTINCT FROM kr.bucket AND e.r = kr.r + 1) s),
node AS MATERIALIZED (SELECT bucket, r, lft, rgt, nl, nr, 1 / d AS lam, nl >= 2 AND nr >= 2 AS split FROM kr WHERE r > 0),
child AS MATERIALIZED (SELECT bucket, r AS p, split, lam, unnest([lft, rgt]) AS c FROM node),
cl(bucket, r, cl) AS (
  SELECT bucket, max(r), max(r) FROM node GROUP BY bucket
  UNION ALL
  SELECT ch.bucket, ch.c, CASE WHEN ch.split THEN ch.c ELSE cl.cl END
  FROM cl JOIN child ch ON ch.bucket IS NOT DISTINCT FROM cl.bucket AND ch.p = cl.r AND ch.c > 0),
top AS MATERIALIZED (SELECT bucket, max(r) AS c, 0::DOUBLE AS birth, NULL::BIGINT AS parent FROM node GROUP BY bucket
        UNION ALL
        SELECT ch.bucket, ch.c, ch.lam, cl.cl FROM child ch JOIN cl ON cl.bucket IS NOT DISTINCT FROM ch.bucket AND cl.r = ch.p
        WHERE ch.split),
stab AS MATERIALIZED (SELECT top.bucket, top.c, top.parent,
                sum((n.lam - top.birth) * CASE WHEN n.split THEN n.nl + n.nr ELSE
                    (CASE WHEN n.nl < 2 THEN n.nl ELSE 0 END) + (CASE WHEN n.nr < 2 THEN n.nr ELSE 0 END) END) AS st
         FROM top JOIN cl ON cl.bucket IS NOT DISTINCT FROM top.bucket AND cl.cl = top.c
              JOIN node n ON n.bucket IS NOT DISTINCT FROM top.bucket AND n.r = cl.r
         GROUP BY top.bucket, top.c, top.parent),
lists AS MATERIALIZED (SELECT bucket, list(c ORDER BY c) AS cs, list(coalesce(parent, 0) ORDER BY c) AS ps, list(st ORDER BY c) AS ss FROM stab GROUP BY bucket),
eom(bucket, cs, ps, ss, best, own, i) AS (
  SELECT bucket, cs, ps, ss, []::DOUBLE[], []::BOOLEAN[], 1 FROM lists
  UNION ALL
  SELECT bucket, cs, ps, ss, list_append(best, greatest(ss[i], sub)), list_append(own, NOT sub > ss[i]), i + 1
  FROM (SELECT *, coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ps[j] = cs[i] THEN best[j] ELSE 0 END)), 0) AS sub
        FROM eom WHERE i <= len(cs)) s),
owned AS MATERIALIZED (SELECT bucket, unnest(cs) AS c, unnest(ps) AS parent, unnest(own) AS own FROM eom WHERE i = len(cs) + 1),
lab(bucket, c, lab) AS (
  SELECT bucket, c, 0::BIGINT FROM owned WHERE parent = 0
  UNION ALL
  SELECT o.bucket, o.c, CASE WHEN lab.lab > 0 THEN lab.lab WHEN o.own THEN o.c ELSE 0 END
  FROM lab JOIN owned o ON o.bucket IS NOT DISTINCT FROM lab.bucket AND o.parent = lab.c),
pt AS MATERIALIZED (SELECT ch.bucket, b.ids[-ch.c] AS id, lab.lab
       FROM child ch JOIN cl ON cl.bucket IS NOT DISTINCT FROM ch.bucket AND cl.r = ch.p
            JOIN lab ON lab.bucket IS NOT DISTINCT FROM ch.bucket AND lab.c = cl.cl
            JOIN b ON b.bucket IS NOT DISTINCT FROM ch.bucket
       WHERE ch.c < 0),
num AS MATERIALIZED (SELECT bucket, lab, row_number() OVER (PARTITION BY bucket ORDER BY min(id)) - 1 AS no, count(*) OVER (PARTITION BY bucket) AS k
        FROM pt WHERE lab > 0 GROUP BY bucket, lab)
SELECT pt.bucket, pt.id AS vec_id, coalesce(num.no, -1)::BIGINT AS cluster
FROM pt LEFT JOIN num ON num.bucket IS NOT DISTINCT FROM pt.bucket AND num.lab = pt.lab
WHERE EXISTS (SELECT 1 FROM num x WHERE x.bucket IS NOT DISTINCT FROM pt.bucket AND x.k > 1)"""


@register("density_cluster", operators=("CLU-2", "CLU-8", "CLU-9", "UDX-3"), sql=_DENSITY_SQL)
def q_density_cluster(spark, sf_dir):
    """Density clusters (min cluster size 2, min samples 1) in every bucket
    of at least 25 rows; -1 = noise."""
    return D.density_cluster(_bucketed(spark, sf_dir), "vec_id", "embedding", "bucket")


@register("density_members", operators=("FLT-6", "FLT-7"), sql=_DENSITY_SQL.replace(
    "SELECT pt.bucket, pt.id AS vec_id, coalesce(num.no, -1)::BIGINT AS cluster",
    ", out AS (SELECT pt.bucket, pt.id AS vec_id, coalesce(num.no, -1)::BIGINT AS cluster") + """)
SELECT bucket, cluster, count(*) AS num_samples, min(vec_id) AS first_id, max(vec_id) AS last_id
FROM out WHERE cluster >= 0 GROUP BY bucket, cluster HAVING count(*) >= 3""")
def q_density_members(spark, sf_dir):
    """Clusters of at least three members, noise dropped."""
    from quarry.operators.buffer_ops import drop_noise, size_gate
    members = drop_noise(q_density_cluster(spark, sf_dir))
    clusters = members.groupBy("bucket", "cluster").agg(F.count(F.lit(1)).alias("num_samples"),
                                                        F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))
    return size_gate(clusters, 3)
