"""The thin queries of this package's operators, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embedding_dedup, hard_negatives, jaccard_join, line_dedup, lm_scoring, mixing, quality, secret_scan, substring_dedup, suffix_dedup, toxicity
from .storage import materialize, release

#: Held-out folds of the contracts: crc32 of the id as text, modulo this.
TOXICITY_FOLDS, LM_FOLDS = (4, 2), (5, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: Column, folds: tuple[int, int]) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds[0] == folds[1]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(docs, path), path))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), TOXICITY_FOLDS))
    settings = toxicity.Settings()
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, "toxic", settings), settings)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), TOXICITY_FOLDS).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), LM_FOLDS)
    counts = materialize(lm_scoring.count_ngrams(docs.where(~held_out)))
    release(spark)
    scored = lm_scoring.score(docs, lm_scoring.fit(counts), counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fit_rates(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["kind"] < len(secret_scan.BASE_RULES))
    of_kind = F.transform("found", lambda x: x["kind"])
    counts = [F.size(F.array_remove(of_kind, i)).alias(f"_{i}") for i in range(len(secret_scan.BASE_RULES))]
    counts = [(F.size("found") - c).cast("long").alias(f"n_{rule.kind}") for c, rule in zip(counts, secret_scan.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("found")).alias("spans"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Words as the contracts have them, of a text with A-Z in lower case.
_LOWERED = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"

#: Links and components by brute force over all pairs.
_COMPONENTS = """reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)"""

SQL = {
    "op3_embedding_dedup": f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
 u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) v from v where list_sum(list_transform(v, lambda y: abs(y))) > 0 and isfinite(list_sum(v))),
 links as materialized (select x.vec_id a, y.vec_id b from u x, u y where x.vec_id <> y.vec_id and list_dot_product(x.v, y.v) >= 0.95), {_COMPONENTS},
 n as (select a, count(*) n from links group by a), low as (select a, min(b) b from reach group by a)
 select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(b, vec_id)) component_id, vec_id <= coalesce(b, vec_id) kept from v left join n on n.a = vec_id left join low on low.a = vec_id""",
    "op5_jaccard_join": f"""with recursive w as (select doc_id, {_WORDS.format(text=_LOWERED.format(text="coalesce(text, '')"))} w from documents),
 s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from w),
 n as (select doc_id, count(*) n from s group by doc_id),
 met as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
 links as materialized (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)), {_COMPONENTS},
 low as (select a, min(b) b from reach group by a)
 select w.doc_id, coalesce(n, 0)::bigint n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) component_id, least(w.doc_id, coalesce(d.first, w.doc_id)) set_id
 from w left join n using (doc_id) left join low on low.a = w.doc_id
 left join (select doc_id, min(doc_id) over (partition by f) first from (select doc_id, list(g order by g) f from s group by doc_id)) d on d.doc_id = w.doc_id""",
    "op10_suffix_dedup": """with t as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
 blocks as (select doc_id, k, substr(h, 200 * k + 1, 400) b from (select doc_id, h, unnest(range(length(h) // 200 + 1)) k from t where length(h) >= 200)),
 p as (select doc_id, 100 * k + o i, substr(b, 2 * o + 1, 200) g from blocks, (select unnest(range(100)) o) where 2 * o + 200 <= length(b)),
 f as materialized (select doc_id, i, row_number() over (partition by g order by doc_id, i) > 1 again from p),
 c as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end fresh from f where again),
 g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) r from c),
 spans as (select doc_id, min(i) a, max(i) + 100 b, r from g group by doc_id, r),
 per as (select doc_id, sum(b - a)::bigint n_removed, count(*) n_spans, list(a order by a) a, list(b order by a) b from spans group by doc_id)
 select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
 sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(range(1, len(a) + 2), lambda k: substr(h, 2 * (case when k = 1 then 0 else b[k - 1] end) + 1, 2 * ((case when k > len(a) then length(h) // 2 else a[k] end) - (case when k = 1 then 0 else b[k - 1] end)))), '') end)) kept_sha256
 from t left join per using (doc_id)""",
}




def _secrets_sql() -> str:
    """Lengths of the pieces between matches and of the matches add up to offsets."""
    parts, spans = [], []
    for i, rule in enumerate(secret_scan.RULES):
        pattern = rule.java.replace("'", "''")
        parts.append(f"regexp_extract_all(t, '{pattern}') m{i}, regexp_extract_all(t, '{pattern}', {rule.group}) g{i}, string_split_regex(t, '{pattern}') p{i}")
        before = lambda c, n, i=i: f"coalesce(list_sum(list_transform({c}{i}[1:{n}], lambda s: length(s))), 0)::bigint"
        start = f"{before('p', 'k')} + {before('m', 'k - 1')}"
        spans.append(f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda k: length(g{i}[k]) >= {rule.least}), lambda k: {{'a': {start}, 'kind': {i}, 'b': {start} + length(m{i}[k])}})")
    kinds = "[" + ", ".join(f"'{rule.kind}'" for rule in secret_scan.RULES) + "]"
    text = lambda which: f"array_to_string(list_transform({which}, lambda s: ({kinds})[s.kind + 1] || ':' || s.a || ':' || s.b), ',')"
    counts = ", ".join(f"len(list_filter(f, lambda s: s.kind = {i}))::bigint n_{rule.kind}" for i, rule in enumerate(secret_scan.BASE_RULES))
    return f"""with d as (select doc_id, coalesce(text, '') t from documents), parts as materialized (select doc_id, {", ".join(parts)} from d),
 found as materialized (select doc_id, list_sort(flatten([{", ".join(spans)}])) f from parts)
 select doc_id, {counts}, sha256({text(f"list_filter(f, lambda s: s.kind < {len(secret_scan.BASE_RULES)})")}) base_sha256, {text("f")} spans from found"""


SQL["op11_secret_scan"] = _secrets_sql()
_SHARE = "1 + (1000000000::hugeint * ({n} + 5)) // ({total} + 5 * {terms})"
SQL["op12_source_divergence"] = f"""with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
 w as materialized (select r, lang, source, unnest(regexp_extract_all({_LOWERED.format(text="t")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
 kept as materialized (select lang, term, count(*) n from w group by lang, term having count(distinct r) >= 30), v as (select lang, count(*) v, sum(n) total from kept group by lang),
 c as (select lang, source, term, count(*) n from w semi join kept using (lang, term) group by all),
 g as materialized (select lang, source, coalesce(v, 0) v, coalesce(v.total, 0) all_total, coalesce(t.total, 0) total from (select distinct lang, source from d) left join (select lang, source, sum(n) total from c group by all) t using (lang, source) left join v using (lang)),
 p as materialized (select lang, g.source, term, coalesce(c.n, 0) n, {_SHARE.format(n="coalesce(c.n, 0)", total="total", terms="v")} p, {_SHARE.format(n="k.n", total="all_total", terms="v")} q from g join kept k using (lang) left join c using (lang, source, term)),
 pairs as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
 everything as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint "value" from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
 union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
 select * from (select *, row_number() over (partition by lang, source, part order by "value" desc, item)::int "rank" from everything) where part = 'pair' or "rank" <= 50"""
SQL["op13_hard_negatives"] = """with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
 where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as materialized (select a.vec_id anchor_id, b.vec_id other_id, a.l = b.l same, list_dot_product(a.q, b.q)::bigint score from v a, v b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 pos as (select anchor_id, other_id positive_id, score positive_score from (select *, row_number() over (partition by anchor_id order by score desc, other_id) r from s where same) where r <= 5)
 select * from (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int "rank", other_id negative_id, positive_score, score negative_score
 from pos join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score) where "rank" <= 3"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can say the whole result: all pairs of vectors, of shingle sets, and of byte strings."""
    return SQL
