"""Queries of symbols, encodings, neighbours, clusters, text, metrics, ensembles, relations and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta import sources, streaming
from trajecta.functions.exprs import flag, r6, sequence_hash, state_code, turn_bin
from trajecta.operators import encode, metrics, neighbours, sessions, symbols, text
from trajecta.plans.registry import EVENTS, Tables, events, query, steps
from trajecta.plans.registry import r6 as s6
from trajecta.plans.sequence import MODES, rounded

# -- symbols --------------------------------------------------------------------------------------------------------


def typed(t: Tables) -> DataFrame:
    return events(t).select("id", "pos", F.col("event_type").alias("symbol"))


def sql_entropy(source: str, keys: str) -> str:
    return f"c AS (SELECT {keys}, symbol, count(*) AS c FROM {source} GROUP BY ALL) SELECT {keys}, {s6('greatest(-sum(c / n * ln(c / n)), 0)', 'entropy')}, {s6('CASE WHEN count(*) > 1 THEN -sum(c / n * ln(c / n)) / ln(count(*)) ELSE 0 END', 'normalised')}, {s6('count(*) / max(n)', 'unique_ratio')} FROM (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS n FROM c) GROUP BY {keys}"


@query("sym_shannon_entropy", EVENTS + ", y AS (SELECT id, event_type AS symbol FROM ev), " + sql_entropy("y", "id"))
def sym_shannon_entropy(t: Tables) -> DataFrame:
    return rounded(symbols.entropy_of(typed(t), "id"), "id")


@query("sym_entropy_thirds", EVENTS + ", y AS (SELECT id, CAST(ceil(3 * pos / n) AS INTEGER) AS third, event_type AS symbol FROM ev), " + sql_entropy("y", "id, third"))
def sym_entropy_thirds(t: Tables) -> DataFrame:
    return rounded(symbols.entropy_of(symbols.thirds(typed(t)), "id", "third"), "id", "third")


@query(
    "sym_transition_entropy",
    EVENTS + f", p AS (SELECT id, event_type AS a, lead(event_type) OVER (PARTITION BY id ORDER BY pos) AS b FROM ev), c AS (SELECT id, a, b, count(*) AS c FROM p WHERE b IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY id, a) AS m, sum(c) OVER (PARTITION BY id) AS n FROM c) SELECT id, {s6('sum(-c / n * ln(c / m))', 'entropy')}, {s6('count(*) / max(n)', 'unique_ratio')}, {s6('max(c) / max(n)', 'top_share')} FROM m GROUP BY id",
)
def sym_transition_entropy(t: Tables) -> DataFrame:
    return rounded(symbols.transitions(typed(t)), "id")


@query("sym_runs", EVENTS + f", r AS (SELECT id, pos - row_number() OVER (PARTITION BY id, event_type ORDER BY pos) AS g, event_type FROM ev), l AS (SELECT id, count(*) AS c FROM r GROUP BY id, event_type, g) SELECT id, count(*) AS n_runs, max(c) AS longest, {s6('avg(c)', 'mean_length')}, {s6('count(*) / sum(c)', 'ratio')} FROM l GROUP BY id")
def sym_runs(t: Tables) -> DataFrame:
    return rounded(symbols.runs(typed(t)), "id", "n_runs", "longest")


@query(
    "sym_permutation_entropy",
    EVENTS + ", l AS (SELECT id, pos, lag(x, 2) OVER w AS a, lag(x) OVER w AS b, x AS c FROM ev WINDOW w AS (PARTITION BY id ORDER BY pos)), y AS (SELECT id, concat(CAST(b < a AS INTEGER) + CAST(c < a AS INTEGER), CAST(a <= b AS INTEGER) + CAST(c < b AS INTEGER), CAST(a <= c AS INTEGER) + CAST(b <= c AS INTEGER)) AS symbol FROM l WHERE a IS NOT NULL), " + sql_entropy("y", "id"),
)
def sym_permutation_entropy(t: Tables) -> DataFrame:
    return rounded(symbols.entropy_of(symbols.permutation_symbols(events(t), "x", 3), "id"), "id")


#: A phrase that began at ``a`` grows by one symbol a step while it occurs earlier.
PHRASES = """, code AS (SELECT id, pos, chr(64 + CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER)) AS c FROM ev),
text AS (SELECT id, string_agg(c, '' ORDER BY pos) AS s FROM code GROUP BY id),
lz AS (
  SELECT id, s, 1 AS a, 1 AS size, 0 AS phrases FROM text
  UNION ALL
  SELECT id, s, CASE WHEN old THEN a ELSE a + size END, CASE WHEN old THEN size + 1 ELSE 1 END, CASE WHEN old THEN phrases ELSE phrases + 1 END
  FROM (SELECT *, a + size - 1 <= length(s) AND contains(substr(s, 1, a + size - 2), substr(s, a, size)) AS old FROM lz WHERE a <= length(s))
), done AS (SELECT id, length(s) AS n, max(phrases) AS complexity FROM lz GROUP BY id, s)
"""


@query("sym_lz_complexity", EVENTS.replace("WITH", "WITH RECURSIVE", 1) + PHRASES + f"SELECT id, n, complexity, {s6('CASE WHEN n > 1 THEN complexity * log2(n) / n END', 'normalised')} FROM done")
def sym_lz_complexity(t: Tables) -> DataFrame:
    return rounded(symbols.lz_complexity(typed(t)), "id", "n", "complexity")


@query("sym_sha1_hash", EVENTS + "SELECT id, substr(sha1(string_agg(event_type, '|' ORDER BY pos)), 1, 16) AS hash FROM ev GROUP BY id")
def sym_sha1_hash(t: Tables) -> DataFrame:
    return sessions.collected(events(t), "event_type").select("id", sequence_hash(F.transform("events", lambda e: e.event_type)).alias("hash"))


STATE = f"{MODES} * 4 + CAST(coalesce(dt > 60000000, false) AS INTEGER) * 2 + CAST(coalesce(step < 50, false) AS INTEGER)"


def stated(df: DataFrame) -> DataFrame:
    return df.withColumn("state", state_code(flag(~F.col("event_type").isin("click", "view")), F.col("dt"), F.col("step"), 60_000_000.0, 50.0))


@query("sym_state", EVENTS + f"SELECT id, pos, CAST({STATE} AS INTEGER) AS state FROM st")
def sym_state(t: Tables) -> DataFrame:
    return stated(steps(t)).select("id", "pos", "state")


@query("sym_tokens_text", EVENTS + f"SELECT id, string_agg(concat('q', CAST({STATE} AS INTEGER), '_', substr(event_type, 1, 1)), ' ' ORDER BY pos) AS tokens FROM st GROUP BY id")
def sym_tokens_text(t: Tables) -> DataFrame:
    rows = stated(steps(t)).withColumn("token", F.concat(F.lit("q"), F.col("state").cast("string"), F.lit("_"), F.substring("event_type", 1, 1)))
    return sessions.collected(rows, "token").select("id", F.array_join(F.transform("events", lambda e: e.token), " ").alias("tokens"))


@query("sym_turn_bins", EVENTS + "SELECT id, CAST(least(floor(((((coalesce(turn, 0) + pi()) % (2*pi())) + 2*pi()) % (2*pi())) / (2*pi()/8)), 7) AS INTEGER) AS sector, count(*) AS n FROM st WHERE angle IS NOT NULL GROUP BY ALL")
def sym_turn_bins(t: Tables) -> DataFrame:
    return steps(t).where("angle is not null").groupBy("id", turn_bin(F.coalesce("turn", F.lit(0.0))).alias("sector")).agg(F.count("*").alias("n"))


@query("sym_turn_categories", EVENTS + "SELECT id, CASE WHEN degrees(turn) > 60 THEN 'sharp_left' WHEN degrees(turn) > 15 THEN 'left' WHEN degrees(turn) >= -15 THEN 'straight' WHEN degrees(turn) >= -60 THEN 'right' ELSE 'sharp_right' END AS category, count(*) AS n FROM st WHERE turn IS NOT NULL GROUP BY ALL")
def sym_turn_categories(t: Tables) -> DataFrame:
    return steps(t).where("turn is not null").groupBy("id", symbols.turn_category(F.col("turn")).alias("category")).agg(F.count("*").alias("n"))


@query("sym_speed_quantile_bins", EVENTS + "SELECT id, pos, CAST(ntile(5) OVER (PARTITION BY id ORDER BY round(speed * 1e6, 6), pos) AS INTEGER) AS bin FROM st WHERE speed IS NOT NULL")
def sym_speed_quantile_bins(t: Tables) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.round(F.col("speed") * 1e6, 6), "pos")
    return steps(t).where("speed is not null").select("id", "pos", F.ntile(5).over(order).alias("bin"))


# -- encodings ------------------------------------------------------------------------------------------------------

LABELLED = "lab AS (SELECT doc_id, lang, source, toxic, quality FROM labels JOIN documents USING (doc_id))"


def labelled(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")


@query("te_fit", f"WITH {LABELLED} SELECT lang, source, {s6('(sum(toxic) + 8 * (SELECT avg(toxic) FROM lab)) / (count(*) + 8)', 'te')}, count(*) AS freq FROM lab GROUP BY ALL")
def te_fit(t: Tables) -> DataFrame:
    return rounded(encode.fit_target_encoding(labelled(t), ["lang", "source"], "toxic"), "lang", "source", "freq")


@query("te_apply", f"WITH {LABELLED}, e AS (SELECT lang, source, (sum(toxic) + 8 * (SELECT avg(toxic) FROM lab)) / (count(*) + 8) AS te, count(*) AS freq FROM lab WHERE doc_id % 3 <> 0 GROUP BY ALL) SELECT doc_id, {s6('coalesce(te, (SELECT avg(toxic) FROM lab))', 'te')}, coalesce(freq, 0) AS freq FROM documents LEFT JOIN e ON documents.lang IS NOT DISTINCT FROM e.lang AND documents.source IS NOT DISTINCT FROM e.source")
def te_apply(t: Tables) -> DataFrame:
    rows = labelled(t)
    rate = rows.agg(F.avg("toxic").alias("rate"))
    part = rows.where("doc_id % 3 <> 0").crossJoin(F.broadcast(rate))
    fitted = part.groupBy("lang", "source").agg(((F.sum("toxic") + F.first("rate") * 8) / (F.count("*") + 8)).alias("te"), F.count("*").alias("freq"))
    docs = t.documents.select("doc_id", "lang", "source").crossJoin(F.broadcast(rate))
    return rounded(encode.apply_target_encoding(docs, fitted, ["lang", "source"], F.col("rate")).select("doc_id", "te", "freq"), "doc_id", "freq")


SPLIT = "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'unlabeled' ELSE 'test' END"
SPLITS = ["train", "unlabeled", "test"]


@query("hash_counts_by_split", f"SELECT substr(sha1(text), 1, 16) AS hash, count(*) AS count_all, {', '.join(f'count(*) FILTER (WHERE {SPLIT} = {s!r}) AS count_{s}' for s in SPLITS)} FROM documents GROUP BY 1")
def hash_counts_by_split(t: Tables) -> DataFrame:
    docs = t.documents.select(F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("hash"), F.expr(SPLIT).alias("split"))
    return encode.hash_counts(docs, "hash", "split", SPLITS)


FOLDS = f"{LABELLED}, fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5(concat(doc_id, ':42'))) - 1) % 5 AS INTEGER) AS fold FROM lab)"


@query("cv_stratified_folds", f"WITH {FOLDS} SELECT doc_id, toxic, fold FROM fo")
def cv_stratified_folds(t: Tables) -> DataFrame:
    return encode.stratified_folds(t.labels.select("doc_id", "toxic"), "doc_id", "toxic")


def folded(t: Tables) -> DataFrame:
    return encode.stratified_folds(labelled(t), "doc_id", "toxic")


@query("cv_fold_filter", f"WITH {FOLDS} SELECT doc_id, source, toxic FROM fo WHERE fold <> 2")
def cv_fold_filter(t: Tables) -> DataFrame:
    return encode.fold_filter(folded(t), 2, False).select("doc_id", "source", "toxic")


@query("cv_group_folds", "SELECT source, CAST(('0x' || substr(md5(concat(source, ':42')), 1, 8))::BIGINT % 5 AS INTEGER) AS fold, count(*) AS n FROM documents GROUP BY ALL")
def cv_group_folds(t: Tables) -> DataFrame:
    return encode.hashed_folds(t.documents.select("source"), "source").groupBy("source", "fold").agg(F.count("*").alias("n"))


def sql_oof(source: str, key: str, label: str, id_col: str) -> str:
    return f"""o AS (SELECT r.{id_col}, r.{key}, r.fold, coalesce(sum(q.{label}), 0) AS s, count(q.{label}) AS n, coalesce(sum(q.{label} * q.{label}), 0) AS sq FROM {source} r LEFT JOIN {source} q ON r.{key} = q.{key} AND r.fold <> q.fold GROUP BY ALL),
f AS (SELECT r.fold, sum(q.{label}) AS s, count(*) AS n, sum(q.{label} * q.{label}) AS sq FROM (SELECT DISTINCT fold FROM {source}) r JOIN {source} q ON r.fold <> q.fold GROUP BY r.fold),
p AS (SELECT o.{id_col}, CASE WHEN o.n > 0 THEN o.s ELSE f.s END AS s, CASE WHEN o.n > 0 THEN o.n ELSE f.n END AS n, CASE WHEN o.n > 0 THEN o.sq ELSE f.sq END AS sq FROM o JOIN f USING (fold)),
z AS (SELECT *, s / n AS m, least(greatest(s / n, 1e-6), 1 - 1e-6) AS b FROM p)
SELECT {id_col}, {s6('s', 'pos_count')}, {s6('n - s', 'neg_count')}, {s6('m', 'target_mean')}, {s6('sqrt(greatest(sq / n - m * m, 0))', 'target_std')}, {s6('-(b * ln(b) + (1 - b) * ln(1 - b))', 'label_entropy')} FROM z"""


STATS = ["pos_count", "neg_count", "target_mean", "target_std", "label_entropy"]


@query("oof_label_stats", f"WITH {FOLDS}, {sql_oof('fo', 'source', 'toxic', 'doc_id')}")
def oof_label_stats(t: Tables) -> DataFrame:
    return rounded(encode.out_of_fold_stats(folded(t), "source", "toxic").select("doc_id", *STATS), "doc_id")


# -- vectors --------------------------------------------------------------------------------------------------------

CENTRES = [[((i * (j + 1)) % 7 - 3) / 20 for i in range(64)] for j in range(6)]
ASSIGNED = "cl AS (SELECT j FROM range(6) r(j)), ce AS (SELECT j, list_transform(range(64), lambda i: ((i * (j + 1)) % 7 - 3) / 20) AS c FROM cl), ad AS (SELECT vec_id, label, j, list_distance(embedding::DOUBLE[], c::DOUBLE[]) AS d FROM embeddings, ce), asg AS (SELECT vec_id, label, CAST(arg_min(j, (d, j)) AS INTEGER) AS cluster, min(d) AS d FROM ad GROUP BY vec_id, label)"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("cluster_assign_fixed", f"WITH {ASSIGNED} SELECT vec_id AS id, cluster, {s6('d', 'centre_distance')} FROM asg")
def cluster_assign_fixed(t: Tables) -> DataFrame:
    return rounded(neighbours.assign(vectors(t), CENTRES).select("id", "cluster", "centre_distance"), "id", "cluster")


@query("cluster_sizes", f"WITH {ASSIGNED} SELECT cluster, count(*) AS size_all, {', '.join(f'count(*) FILTER (WHERE vec_id % 3 = {k}) AS size_{s}' for k, s in enumerate(SPLITS))}, {s6('1 / (avg(d) + 0.001)', 'density')} FROM asg GROUP BY cluster")
def cluster_sizes(t: Tables) -> DataFrame:
    split = F.expr(SPLIT.replace("doc_id", "id"))
    return rounded(neighbours.cluster_sizes(neighbours.assign(vectors(t), CENTRES).withColumn("split", split), "split", SPLITS), "cluster", "size_all", *(f"size_{s}" for s in SPLITS))


@query("cluster_label_stats", f"WITH {ASSIGNED}, fo AS (SELECT vec_id, cluster, CAST(label < 5 AS INTEGER) AS y, vec_id % 5 AS fold FROM asg), {sql_oof('fo', 'cluster', 'y', 'vec_id')}")
def cluster_label_stats(t: Tables) -> DataFrame:
    rows = neighbours.assign(vectors(t), CENTRES).select(F.col("id").alias("vec_id"), "cluster", flag(F.col("label") < 5).alias("y"), (F.col("id") % 5).alias("fold"))
    return rounded(encode.out_of_fold_stats(rows, "cluster", "y").select("vec_id", *STATS), "vec_id")


def sql_knn(k: int, where: str) -> str:
    return f"kd AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings c ON {where}), kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM kd), kn AS (SELECT * FROM kr WHERE rank <= {k})"


@query("knn_self", f"WITH {sql_knn(5, 'q.vec_id <> c.vec_id')} SELECT query_id, rank, id, {s6('d', 'distance')} FROM kn")
def knn_self(t: Tables) -> DataFrame:
    return rounded(neighbours.nearest(vectors(t), vectors(t), 5, same=True), "query_id", "rank", "id")


@query("knn_cross", f"WITH {sql_knn(3, 'q.vec_id % 3 <> c.vec_id % 3')} SELECT query_id, rank, id, {s6('d', 'distance')} FROM kn")
def knn_cross(t: Tables) -> DataFrame:
    """Each split's rows against the other splits'."""
    v = vectors(t)
    parts = [neighbours.nearest(v.where(F.col("id") % 3 == k), v.where(F.col("id") % 3 != k), 3) for k in range(3)]
    return rounded(encode.reduce(lambda a, b: a.unionByName(b), parts), "query_id", "rank", "id")


def blocks(t: Tables) -> DataFrame:
    """Vectors in three splits, of which the first is labelled and dealt into folds."""
    split = F.expr(SPLIT.replace("doc_id", "id"))
    return vectors(t).select("id", "vector", split.alias("split"), F.when(F.col("id") % 3 == 0, flag(F.col("label") < 5)).alias("label"), (F.col("id") / 3).cast("int").alias("place")).withColumn("fold", F.col("place") % 5)


BLOCK = f"em AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {SPLIT.replace('doc_id', 'vec_id')} AS split, CASE WHEN vec_id % 3 = 0 THEN CAST(label < 5 AS INTEGER) END AS label, CASE WHEN vec_id % 3 = 0 THEN (vec_id // 3) % 5 ELSE -1 END AS fold FROM embeddings)"
BLOCK_KNN = f"""WITH {BLOCK}, pd AS (SELECT q.id, c.id AS cid, c.split AS csplit, list_distance(q.v, c.v) AS d FROM em q JOIN em c ON q.id <> c.id), pr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS rank FROM pd),
da AS (SELECT id, min(d) AS d1, {', '.join(f'avg(d) FILTER (WHERE rank <= {k}) AS d{k}m' for k in (3, 5, 10, 20))}, stddev_pop(d) FILTER (WHERE rank <= 10) AS ds, {', '.join(f"min(d) FILTER (WHERE csplit = '{s}') AS m_{s}" for s in SPLITS)} FROM pr GROUP BY id),
lp AS (SELECT q.id, q.fold, c.label, list_distance(q.v, c.v) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, c.v), c.id) AS rank FROM em q JOIN em c ON c.label IS NOT NULL AND q.fold <> c.fold),
la AS (SELECT id, fold, {', '.join(f'avg(label) FILTER (WHERE rank <= {k}) AS l{k}' for k in (3, 5, 10))}, stddev_pop(label) AS ls, min(d) FILTER (WHERE label = 1) AS p, min(d) FILTER (WHERE label = 0) AS n, max(d) AS last FROM lp WHERE rank <= 10 GROUP BY id, fold),
lm AS (SELECT *, CASE WHEN fold >= 0 THEN max(last) OVER (PARTITION BY fold) ELSE last END AS miss FROM la), lf AS (SELECT *, coalesce(p, miss) AS pp, coalesce(n, miss) AS nn FROM lm)
"""


@query(
    "knn_block",
    BLOCK_KNN + f"SELECT da.id AS id, {s6('d1', 'knn_dist_1')}, {', '.join(s6(f'd{k}m', f'knn_dist_{k}_mean') for k in (3, 5, 10, 20))}, {s6('ds', 'knn_dist_std_10')}, {', '.join(s6(f'm_{s}', f'knn_{s}_dist_min') for s in SPLITS)}, {', '.join(s6(f'l{k}', f'knn_train_label_mean_{k}') for k in (3, 5, 10))}, {s6('ls', 'knn_train_label_std_10')}, {s6('pp', 'knn_train_pos_dist_min')}, {s6('nn', 'knn_train_neg_dist_min')}, {s6('nn / (pp + 0.001)', 'knn_neg_pos_ratio')} FROM da JOIN lf ON lf.id = da.id",
)
def knn_block(t: Tables) -> DataFrame:
    return rounded(neighbours.knn_block(blocks(t), SPLITS), "id")


STAT_SQL = "s AS pos_count, n - s AS neg_count, s / n AS target_mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS target_std"
CLUSTER_COLUMNS = ["id", "size_all", *(f"size_{s}" for s in SPLITS), "distance_to_center", "density_proxy", "target_mean", "target_std", "label_entropy", "pos_count", "neg_count"]


@query(
    "cluster_block",
    f"""WITH {BLOCK}, ce AS (SELECT j, list_transform(range(64), lambda i: ((i * (j + 1)) % 7 - 3) / 20) AS c FROM range(6) r(j)), ad AS (SELECT em.*, j, list_distance(v, c::DOUBLE[]) AS d FROM em, ce),
ag AS (SELECT id, split, label, fold, arg_min(j, (d, j)) AS cluster, min(d) AS d FROM ad GROUP BY id, split, label, fold), sz AS (SELECT cluster, count(*) AS size_all, {', '.join(f"count(*) FILTER (WHERE split = '{s}') AS size_{s}" for s in SPLITS)} FROM ag GROUP BY cluster),
kf AS (SELECT DISTINCT cluster, fold FROM ag), own AS (SELECT kf.cluster, kf.fold, CAST(sum(label) AS DOUBLE) AS s, count(label) AS n FROM kf LEFT JOIN ag ON ag.cluster = kf.cluster AND ag.fold <> kf.fold AND label IS NOT NULL GROUP BY ALL),
al AS (SELECT f.fold, CAST(sum(label) AS DOUBLE) AS s, count(label) AS n FROM (SELECT DISTINCT fold FROM ag) f JOIN ag ON ag.fold <> f.fold AND label IS NOT NULL GROUP BY f.fold),
us AS (SELECT own.cluster, own.fold, CASE WHEN own.n > 0 THEN own.s ELSE al.s END AS s, CASE WHEN own.n > 0 THEN own.n ELSE al.n END AS n, CASE WHEN own.n > 0 THEN own.s ELSE al.s END AS q FROM own JOIN al ON al.fold = own.fold), st AS (SELECT cluster, fold, {STAT_SQL}, least(greatest(s / n, 1e-6), 1 - 1e-6) AS m FROM us),
fi AS (SELECT ag.id AS rid, CAST(ag.cluster AS DOUBLE) AS id, sz.* EXCLUDE (cluster), d AS distance_to_center, 1 / (d + 0.001) AS density_proxy, target_mean, target_std, -(m * ln(m) + (1 - m) * ln(1 - m)) AS label_entropy, pos_count, neg_count FROM ag JOIN sz ON sz.cluster = ag.cluster JOIN st ON st.cluster = ag.cluster AND st.fold = ag.fold)
SELECT rid AS id, {', '.join(s6(f'fi.{c}', f'cluster_6_{c}') for c in CLUSTER_COLUMNS)} FROM fi""",
)
def cluster_block(t: Tables) -> DataFrame:
    return rounded(neighbours.cluster_block(blocks(t), CENTRES, "cluster_6", SPLITS), "id")


@query("knn_label_oof", f"WITH {sql_knn(10, 'q.vec_id % 5 <> c.vec_id % 5')} SELECT query_id, {', '.join(s6(f'avg(CAST(label < 5 AS INTEGER)) FILTER (WHERE rank <= {k})', f'label_mean_{k}') for k in (1, 3, 5, 10))}, {s6('stddev_pop(d)', 'dist_std')} FROM kn GROUP BY query_id")
def knn_label_oof(t: Tables) -> DataFrame:
    v = vectors(t)
    labels = v.select("id", flag(F.col("label") < 5).alias("label"))
    # a row's neighbours are those of the other folds
    by_fold = [neighbours.nearest(v.where(F.col("id") % 5 == k), v.where(F.col("id") % 5 != k), 10) for k in range(5)]
    found = by_fold[0]
    for more in by_fold[1:]:
        found = found.unionByName(more)
    features = neighbours.neighbour_features(found, labels)
    return rounded(features.select("query_id", *(f"label_mean_{k}" for k in (1, 3, 5, 10)), "dist_std"), "query_id")


@query("knn_class_distance", f"WITH {sql_knn(10, 'q.vec_id <> c.vec_id')}, m AS (SELECT query_id, coalesce(min(d) FILTER (WHERE label < 5), max(d)) AS p, coalesce(min(d) FILTER (WHERE label >= 5), max(d)) AS n FROM kn GROUP BY query_id) SELECT query_id, {s6('p', 'pos_dist_min')}, {s6('n', 'neg_dist_min')}, {s6('n / (p + 0.001)', 'neg_pos_ratio')} FROM m")
def knn_class_distance(t: Tables) -> DataFrame:
    v = vectors(t)
    features = neighbours.neighbour_features(neighbours.nearest(v, v, 10, same=True), v.select("id", flag(F.col("label") < 5).alias("label")))
    return rounded(features.select("query_id", "pos_dist_min", "neg_dist_min", "neg_pos_ratio"), "query_id")


# -- text -----------------------------------------------------------------------------------------------------------

GRAMS = EVENTS + """, w AS (SELECT id, event_type AS a, lead(event_type) OVER o AS b, lead(event_type, 2) OVER o AS c, lead(event_type, 3) OVER o AS d FROM ev WINDOW o AS (PARTITION BY id ORDER BY pos)),
gr AS (SELECT id, concat(a, ' ', b) AS term FROM w WHERE b IS NOT NULL UNION ALL SELECT id, concat(a, ' ', b, ' ', c) FROM w WHERE c IS NOT NULL UNION ALL SELECT id, concat(a, ' ', b, ' ', c, ' ', d) FROM w WHERE d IS NOT NULL),
tc AS (SELECT id, term, count(*) AS tf FROM gr GROUP BY ALL), vo AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tc GROUP BY term HAVING count(*) >= 3 ORDER BY cf DESC, term LIMIT 4000)
"""


def terms(t: Tables) -> DataFrame:
    rows = sessions.collected(events(t), "event_type").select("id", F.transform("events", lambda e: e.event_type).alias("tokens"))
    return text.term_counts(rows, "id", "tokens", 2, 4)


@query("text_ngrams", GRAMS + "SELECT id, term, tf FROM tc")
def text_ngrams(t: Tables) -> DataFrame:
    return terms(t)


@query("topk_ngrams", GRAMS + "SELECT term, df, cf FROM vo")
def topk_ngrams(t: Tables) -> DataFrame:
    return text.vocabulary(terms(t))


@query("text_tfidf", GRAMS + f", wt AS (SELECT id, term, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(DISTINCT id) FROM ev)) / (1 + df))) AS w FROM tc JOIN vo USING (term)) SELECT id, term, {s6('w / sqrt(sum(w * w) OVER (PARTITION BY id))', 'weight')} FROM wt")
def text_tfidf(t: Tables) -> DataFrame:
    counts = terms(t)
    n = t.events.agg(F.countDistinct("user_id").alias("n_texts"))
    return rounded(text.tfidf(counts.crossJoin(F.broadcast(n)), text.vocabulary(counts), F.col("n_texts")), "id", "term")


# -- metrics and ensembles ------------------------------------------------------------------------------------------

SCORES = {"m1": "(doc_id * 37 % 101) / 100", "m2": "least((doc_id * 53 % 97) / 120 + toxic * 0.2, 0.99)", "m3": "round((doc_id * 11 % 89) / 89, 1)"}
SCORED = f"sc AS (SELECT doc_id, toxic, model, CASE model {' '.join(f'WHEN {m!r} THEN {s}' for m, s in SCORES.items())} END AS score FROM labels, (VALUES ('m1'), ('m2'), ('m3')) v(model))"


def scored(t: Tables) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.expr(s.replace("0.2", "0.2D").replace("0.99", "0.99D")).cast("double").alias("score")) for m, s in SCORES.items())))
    return t.labels.select("doc_id", "toxic", each.alias("s")).select("doc_id", "toxic", "s.model", "s.score")


POINTS = f"""WITH {SCORED}, g AS (SELECT model, score, count(*) FILTER (WHERE toxic = 1) AS dp, count(*) FILTER (WHERE toxic = 0) AS dn FROM sc GROUP BY ALL),
pt AS (SELECT *, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER (PARTITION BY model) AS p, sum(dn) OVER (PARTITION BY model) AS n FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))
"""


@query("metric_auc", POINTS + f"SELECT model, {s6('sum(dn * (tp - dp / 2)) / (max(p) * max(n))', 'auc')} FROM pt GROUP BY model")
def metric_auc(t: Tables) -> DataFrame:
    return rounded(metrics.auc(scored(t), "toxic", "score", "model"), "model")


@query("metric_pauc", POINTS + f""", sg AS (SELECT model, (fp - dn) / n AS x0, fp / n AS x1, (tp - dp) / p AS y0, tp / p AS y1 FROM pt), ar AS (SELECT model, sum(CASE WHEN x0 >= 0.1 THEN 0 WHEN x1 <= 0.1 THEN (x1 - x0) * (y0 + y1) / 2 ELSE (0.1 - x0) * (2 * y0 + (y1 - y0) * (0.1 - x0) / (x1 - x0)) / 2 END) AS a FROM sg GROUP BY model)
SELECT model, {s6('0.5 * (1 + (a - 0.005) / (0.1 - 0.005))', 'pauc')} FROM ar""")
def metric_pauc(t: Tables) -> DataFrame:
    return rounded(metrics.partial_auc(scored(t), "toxic", "score", 0.1, "model"), "model")


CLIPPED = "least(greatest(score, 1e-6), 1 - 1e-6)"
LOSSES = f"ls AS (SELECT model, avg(-(toxic * ln({CLIPPED}) + (1 - toxic) * ln(1 - {CLIPPED}))) AS logloss, avg((score - toxic) * (score - toxic)) AS brier FROM sc GROUP BY model)"


def losses(t: Tables) -> DataFrame:
    return scored(t).groupBy("model").agg(metrics.log_loss(F.col("toxic"), F.col("score")).alias("logloss"), metrics.brier(F.col("toxic"), F.col("score")).alias("brier"))


@query("metric_logloss_brier", f"WITH {SCORED}, {LOSSES} SELECT model, {s6('logloss')}, {s6('brier')} FROM ls")
def metric_logloss_brier(t: Tables) -> DataFrame:
    return rounded(losses(t), "model")


@query("model_leaderboard", f"WITH {SCORED}, {LOSSES} SELECT model, {s6('logloss')}, CAST(row_number() OVER (ORDER BY logloss, model) AS INTEGER) AS place FROM ls ORDER BY place")
def model_leaderboard(t: Tables) -> DataFrame:
    ranked = losses(t).select("model", "logloss", F.row_number().over(Window.partitionBy().orderBy("logloss", "model")).alias("place"))
    return rounded(ranked, "model", "place").orderBy("place")


@query("ensemble_weights", f"WITH {SCORED}, {LOSSES} SELECT model, {s6('(1 / (logloss * logloss)) / sum(1 / (logloss * logloss)) OVER ()', 'weight')} FROM ls")
def ensemble_weights(t: Tables) -> DataFrame:
    return rounded(metrics.inverse_square_weights(losses(t), "logloss").select("model", "weight"), "model")


def wide(t: Tables) -> DataFrame:
    return scored(t).groupBy("doc_id", "toxic").pivot("model", list(SCORES)).agg(F.first("score"))


WIDE = "wd AS (SELECT doc_id, toxic, max(score) FILTER (WHERE model = 'm1') AS m1, max(score) FILTER (WHERE model = 'm2') AS m2, max(score) FILTER (WHERE model = 'm3') AS m3 FROM sc GROUP BY ALL)"


@query("ensemble_weighted_mean", f"WITH {SCORED}, {WIDE} SELECT doc_id, {s6('(0.386 * m1 + 0.377 * m2 + 0.238 * m3) / 1.001', 'blend')} FROM wd")
def ensemble_weighted_mean(t: Tables) -> DataFrame:
    return rounded(wide(t).select("doc_id", metrics.weighted_mean({"m1": 0.386, "m2": 0.377, "m3": 0.238}).alias("blend")), "doc_id")


RANKED = "rk AS (SELECT *, (rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2) / count(*) OVER (PARTITION BY model) AS pct FROM sc)"


@query("win_avg_rank_pct", f"WITH {SCORED}, {RANKED} SELECT doc_id, model, {s6('pct', 'rank_pct')} FROM rk")
def win_avg_rank_pct(t: Tables) -> DataFrame:
    return rounded(metrics.rank_percent(scored(t), "score", "model").select("doc_id", "model", "rank_pct"), "doc_id", "model")


RANK_BLEND = "sum(pct * CASE model WHEN 'm1' THEN 2 WHEN 'm2' THEN 1 ELSE 0 END) / 3"


@query("ensemble_rank_average", f"WITH {SCORED}, {RANKED} SELECT doc_id, {s6(RANK_BLEND, 'blend')} FROM rk GROUP BY doc_id")
def ensemble_rank_average(t: Tables) -> DataFrame:
    return rounded(metrics.rank_average(wide(t), {"m1": 2, "m2": 1, "m3": 0}, "doc_id", "blend"), "doc_id")


@query("calib_blend", f"WITH {SCORED}, p AS (SELECT doc_id, score, {CLIPPED} AS q FROM sc WHERE model = 'm1') SELECT doc_id, {s6('least(greatest(0.7 / (1 + exp(-(0.8 * ln(q / (1 - q)) - 0.3))) + 0.3 * score, 0.001), 0.999)', 'p')} FROM p")
def calib_blend(t: Tables) -> DataFrame:
    return rounded(scored(t).where("model = 'm1'").select("doc_id", metrics.calibrated(F.col("score"), 0.8, -0.3).alias("p")), "doc_id")


@query("cv_fold_scores", f"WITH {SCORED}, {FOLDS}, g AS (SELECT fold, score, count(*) FILTER (WHERE sc.toxic = 1) AS dp, count(*) FILTER (WHERE sc.toxic = 0) AS dn FROM sc JOIN fo USING (doc_id) WHERE model = 'm2' GROUP BY ALL), pt AS (SELECT *, sum(dp) OVER (PARTITION BY fold ORDER BY score DESC) AS tp, sum(dp) OVER (PARTITION BY fold) AS p, sum(dn) OVER (PARTITION BY fold) AS n FROM g) SELECT fold, {s6('sum(dn * (tp - dp / 2)) / (max(p) * max(n))', 'auc')} FROM pt GROUP BY fold")
def cv_fold_scores(t: Tables) -> DataFrame:
    rows = scored(t).where("model = 'm2'").join(folded(t).select("doc_id", "fold"), "doc_id")
    return rounded(metrics.auc(rows, "toxic", "score", "fold"), "fold")


# -- relations ------------------------------------------------------------------------------------------------------


@query("join_inner_agg", f"SELECT n_name, o_orderpriority, count(*) AS n, {s6('sum(l_extendedprice * (1 - l_discount))', 'revenue', 4)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY ALL")
def join_inner_agg(t: Tables) -> DataFrame:
    orders = t.orders.where("o_orderstatus <> 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_asof", f"WITH c AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT c.event_id, {s6('v.value', 'last_view')} FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts")
def join_asof(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.lit(None).cast("double").alias("seen"), F.lit(1).alias("side"))
    right = t.events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("seen")).select("user_id", "ts", F.lit(None).cast("long").alias("event_id"), "seen", F.lit(0).alias("side"))
    # both sides in one order, the right one first at equal times: one shuffle and no range condition
    order = Window.partitionBy("user_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("last_view", F.last("seen", ignorenulls=True).over(order))
    return rounded(found.where("side = 1").select("event_id", "last_view"), "event_id")


@query("agg_rollup", f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, {s6('sum(l_quantity)', 'quantity')} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t: Tables) -> DataFrame:
    return rounded(t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), "l_returnflag", "l_linestatus", "level", "n")


@query("agg_cube", f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, {s6('sum(l_quantity)', 'quantity')} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t: Tables) -> DataFrame:
    return rounded(t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), "l_returnflag", "l_linestatus", "level", "n")


@query("setop_union_splits", "SELECT doc_id, 'labelled' AS split, CAST(toxic AS VARCHAR) AS toxic FROM labels UNION ALL SELECT doc_id, 'all', NULL FROM documents")
def setop_union_splits(t: Tables) -> DataFrame:
    return encode.union_splits({"labelled": t.labels.select("doc_id", F.col("toxic").cast("string").alias("toxic")), "all": t.documents.select("doc_id")}).select("doc_id", "split", "toxic")


@query("setop_intersect", "SELECT user_id FROM events WHERE value > 480 INTERSECT SELECT user_id FROM events WHERE value < 5")
def setop_intersect(t: Tables) -> DataFrame:
    return t.events.where("value > 480").select("user_id").intersect(t.events.where("value < 5").select("user_id"))


@query("setop_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def setop_except(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


# -- streams --------------------------------------------------------------------------------------------------------


@query("stream_tumbling", f"SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) / 1000000 AS BIGINT) AS window_start, event_type, count(*) AS n, {s6('sum(value)', 'total')} FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    stream = streaming.tumbling(streaming.event_stream(t.spark, f"{t.folder}/events.parquet"), "1 day", "1 hour", "event_type")
    table = streaming.run_to_end(stream, sources.work_folder(t.spark))
    return rounded(table.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", "total"), "window_start", "event_type", "n")


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(epoch_us(ts)) AS session_start, max(epoch_us(ts)) + 21600000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(t: Tables) -> DataFrame:
    stream = streaming.sessions(streaming.event_stream(t.spark, f"{t.folder}/events.parquet"), "6 hours", "1 hour", "user_id")
    table = streaming.run_to_end(stream, sources.work_folder(t.spark))
    return table.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")
