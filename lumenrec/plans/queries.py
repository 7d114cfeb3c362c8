"""Named queries over the stored tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import compressed as Z
from ..operators import features as X
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import preprocess as P
from ..operators import ranker as L
from ..operators import rerank as K
from ..operators import retrieval as R
from ..operators import search as S
from ..operators import towers as W
from ..sources import npy as NP
from ..sources import tables as T
from ..sources.store import shared_path, stored
from ..streaming import events as E

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}

INTER = """inter as (select user_id, cast(json_extract_string(props, '$.k') as bigint) item_id,
 cast(((cast(floor(value) as bigint) % 10) + 1) * 0.5 as double) rating, ts, cast(floor(epoch(ts)) as bigint) sec, event_id from events)"""
BIG = """big as (select o_custkey user_id, l_partkey item_id, cast((((cast(l_quantity as int) - 1) % 10) + 1) * 0.5 as double) rating,
 cast(floor(epoch(l_shipdate)) as bigint) sec from lineitem join orders on l_orderkey = o_orderkey)"""
MOVIES = """movies as (select p_partkey item_id, p_name || ' (' || cast(1950 + p_size as varchar) || ')' title, p_type || '|' || p_brand genres, p_name tag_text from part)"""
CATALOG = f"""{INTER}, {MOVIES}, votes as (select item_id, count(*) vc, avg(rating) m from inter group by item_id),
 catalog as (select item_id, title, string_split(genres, '|') genres, string_split(lower(tag_text), ' ') tags, cast(regexp_extract(title, '(\\d{{4}})\\)$', 1) as int) "year",
 case when item_id % 10 = 0 then 'tv' else 'movie' end media_type, (['en','hi','fr','es','ja','ko'])[(item_id % 6) + 1] original_language,
 coalesce(vc, 0) vote_count, coalesce(m, 0.0) vote_average from movies left join votes using (item_id))"""
VECTORS = "vec as (select vec_id item_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings)"
DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
USERS = f"""{INTER}, {VECTORS}, idx as (select unnest(range(1, 65)) i), usum as (select user_id, i, avg(v[i]) x from inter join vec using (item_id), idx group by user_id, i),
 umean as (select user_id, list(x order by i) m from usum group by user_id),
 uvec as (select user_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) v from umean)"""
SCORED = f"""{USERS}, scored as (select user_id, item_id, round({DOT.format(a='uvec.v', b='vec.v')}, 6) score from uvec, vec),
 ranked as (select *, row_number() over (partition by user_id order by score desc, item_id) r from scored)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _r(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _users(spark, d):
    return R.user_vectors(T.interactions(spark, d), T.item_vectors(spark, d))


def _lists(spark, d, k=100):
    """Top ``k`` of every user over all items, stored: the lists that are judged and ranked again."""
    return stored(R.knn(_users(spark, d), T.item_vectors(spark, d), "user_id", k))


def _truth(spark, d):
    return T.interactions(spark, d).where("rating >= 4").select("user_id", "item_id").distinct()


# --- sources ---------------------------------------------------------------------------------


@query(f"with {BIG} select user_id, item_id, rating, sec from big")
def ratings_scan(spark: SparkSession, d: str) -> DataFrame:
    return T.ratings_big(spark, d)


@query(f"with {INTER} select user_id, item_id, rating, sec from (select *, row_number() over (order by sec, user_id, item_id, rating) r from inter) where r <= 1000")
def csv_first_rows(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark)
    T.interactions(spark, d).select("user_id", "item_id", "rating", "sec").write.csv(path, header=True)
    return T.read_ratings_csv(spark, path, 1000)


@query(f"with {INTER} select event_type, count(*) n, cast(sum(k) as bigint) k from (select event_type, cast(json_extract_string(props, '$.k') as bigint) k from events) group by event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query(f"with {MOVIES}, top as (select max(item_id) m from movies), extra as (select title, row_number() over (order by title) r from (select n_name || ' (1999)' title from nation)) select item_id, title from movies union all select m + r, title from extra, top")
def append_ids(spark: SparkSession, d: str) -> DataFrame:
    extra = T.read(spark, d, "nation").select(F.concat("n_name", F.lit(" (1999)")).alias("title"))
    return C.append(T.movies(spark, d), extra, "title")


# --- preprocessing ---------------------------------------------------------------------------


@query(f"with {MOVIES} select item_id, title, len(string_split(genres, '|')) n_genres, cast(nullif(regexp_extract(title, '(\\d{{4}})', 1), '') as bigint) \"year\", regexp_replace(title, '\\s*\\(\\d{{4}}\\)\\s*$', '') clean_title from movies")
def movies_parse(spark: SparkSession, d: str) -> DataFrame:
    m = P.parse_movies(T.movies(spark, d))
    return m.select("item_id", "title", F.size("genres_list").cast("long").alias("n_genres"), F.col("year").cast("long").alias("year"), "clean_title")


TAGS = "tags as (select p_partkey item_id, unnest(string_split(p_name, ' ')) tag, unnest(range(len(string_split(p_name, ' ')))) ord from part)"


def _tags(spark, d):
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.posexplode(F.split("p_name", " ")).alias("ord", "tag"))


@query(f"with {TAGS} select item_id, string_agg(lower(tag), ' ' order by ord) tags_text from tags group by item_id")
def tags_text(spark: SparkSession, d: str) -> DataFrame:
    return P.tags_text(_tags(spark, d))


def _kcore_sql(users: int, items: int) -> str:
    parts, last = [BIG], "big"
    for i in range(5):
        parts.append(f"u{i} as (select * from {last} where user_id in (select user_id from {last} group by user_id having count(*) >= {users}))")
        parts.append(f"i{i} as materialized (select * from u{i} where item_id in (select item_id from u{i} group by item_id having count(*) >= {items}))")
        last = f"i{i}"
    return f"with {', '.join(parts)} select user_id, item_id, rating, sec from {last}"


@query(_kcore_sql(5, 5))
def kcore_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.k_core(T.ratings_big(spark, d), cut=stored)


@query(_kcore_sql(30, 20))
def kcore_cascade(spark: SparkSession, d: str) -> DataFrame:
    return P.k_core(T.ratings_big(spark, d), 30, 20, cut=stored)


@query(f"with {BIG}, u as (select user_id, row_number() over (order by user_id) - 1 user_idx from (select distinct user_id from big)), i as (select item_id, row_number() over (order by item_id) - 1 item_idx from (select distinct item_id from big)) select user_id, item_id, rating, sec, user_idx, item_idx from big join u using (user_id) join i using (item_id)")
def id_encoding(spark: SparkSession, d: str) -> DataFrame:
    return P.encode(T.ratings_big(spark, d)).select("user_id", "item_id", "rating", "sec", "user_idx", "item_idx")


@query(f"with {INTER} select event_id, hour(ts) hour_of_day, isodow(ts) - 1 day_of_week, month(ts) \"month\", year(ts) \"year\", round((sec - min(sec) over (partition by user_id)) / 86400.0, 6) days_since_first, round((sec - min(sec) over ()) / 86400.0, 6) global_days from inter")
def temporal_features(spark: SparkSession, d: str) -> DataFrame:
    return P.temporal_features(T.interactions(spark, d)).select("event_id", "hour_of_day", "day_of_week", "month", "year", *_r("days_since_first", "global_days"))


@query(f"with {INTER}, n as (select count(*) n from inter), o as (select event_id, row_number() over (order by sec, user_id, item_id, event_id) - 1 p from inter) select event_id, case when p < floor(n * 0.8) then 'train' when p < floor(n * 0.9) then 'val' else 'test' end split from o, n")
def time_split(spark: SparkSession, d: str) -> DataFrame:
    return P.time_split(T.interactions(spark, d), ["user_id", "item_id", "event_id"]).select("event_id", "split")


NEG = """seen as (select distinct user_id, item_id from inter), want as (select user_id, count(*) * 4 wanted from seen group by user_id), items as (select distinct item_id from seen),
 neg as (select user_id, item_id from (select w.user_id, i.item_id, wanted, row_number() over (partition by w.user_id order by md5('42:' || w.user_id || ':' || i.item_id), i.item_id) r
 from want w cross join items i anti join seen s on s.user_id = w.user_id and s.item_id = i.item_id) where r <= wanted)"""


@query(f"with {INTER}, {NEG} select user_id, item_id from neg")
def negative_sampling(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_negatives(T.interactions(spark, d))


@query(f"""with {BIG}, seen as (select distinct user_id, item_id from big), idx as (select item_id, row_number() over (order by item_id) - 1 x from (select distinct item_id from seen)), ni as (select count(*) n from idx),
 want as (select user_id, count(*) own, count(*) * 4 w from seen group by user_id),
 draws as (select user_id, j, w, ('0x' || substr(md5('42:' || user_id || ':' || j), 1, 12))::bigint % n x from (select user_id, w, unnest(range(1, 3 * w + 1)) j from want, ni where 2 * (own + w) <= n), ni),
 fresh as (select d.user_id, i.item_id, min(j) j, any_value(w) w from draws d join idx i using (x) anti join seen s on s.user_id = d.user_id and s.item_id = i.item_id group by all),
 drawn as materialized (select user_id, item_id, w from (select *, row_number() over (partition by user_id order by j) r from fresh) where r <= w),
 enough as (select user_id from drawn group by user_id having count(*) = any_value(w)),
 rest as (select user_id, item_id from (select w.user_id, i.item_id, w, row_number() over (partition by w.user_id order by md5('42:' || w.user_id || ':' || i.item_id), i.item_id) r
 from (select * from want anti join enough using (user_id)) w cross join idx i anti join seen s on s.user_id = w.user_id and s.item_id = i.item_id) where r <= w)
 select user_id, item_id from drawn semi join enough using (user_id) union all select * from rest""")
def negative_sampling_drawn(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_negatives(T.ratings_big(spark, d))


HASHED = "h as (select event_id, md5('42:' || event_id) h from events)"


@query(f"with {HASHED}, picked as (select event_id, row_number() over (order by h, event_id) - 1 x from h), n as (select least(count(*), 5000) n from h) select event_id, case when x < floor(n * 0.8) then 'train' else 'val' end split from picked, n where x < n")
def sample_split(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_split(T.interactions(spark, d).select("event_id"), 5000, ["event_id"])


@query(f"with {HASHED} select event_id, row_number() over (order by h) - 1 place from h")
def shuffle_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.shuffled(T.interactions(spark, d).select("event_id"), ["event_id"])


@query("select p_partkey item_id, regexp_replace(p_name || ' (' || cast(1950 + p_size as varchar) || ')', '\\s*\\(\\d{4}\\)\\s*$', '') || ' ' || case when p_partkey % 5 = 0 then '' else lower(p_name) end \"text\" from part")
def title_tags_text(spark: SparkSession, d: str) -> DataFrame:
    m = P.parse_movies(T.movies(spark, d)).withColumn("tags", F.when(F.col("item_id") % 5 != 0, F.lower("tag_text")))
    return m.select("item_id", P.item_text(F.col("clean_title"), F.col("tags")).alias("text"))


DATES = "dates as (select p_partkey item_id, case when p_partkey % 9 = 0 then null when p_partkey % 7 = 0 then 'unknown' else cast(1950 + p_size as varchar) || '-05-' || lpad(cast(p_partkey % 28 + 1 as varchar), 2, '0') end release_date from part)"


def _dates(spark, d):
    i = F.col("p_partkey")
    text = F.concat((F.lit(1950) + F.col("p_size")).cast("string"), F.lit("-05-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"))
    return T.read(spark, d, "part").select(i.alias("item_id"), F.when(i % 9 == 0, None).when(i % 7 == 0, "unknown").otherwise(text).alias("release_date"))


@query(f"with {DATES} select item_id, try_cast(split_part(release_date, '-', 1) as int) \"year\" from dates")
def release_year(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark, d).select("item_id", P.year_of(F.col("release_date")).alias("year"))


@query(f"with {INTER}, {NEG} select user_id, item_id, 1 \"label\" from seen union all select user_id, item_id, 0 from neg")
def interaction_dataset(spark: SparkSession, d: str) -> DataFrame:
    return P.interaction_dataset(T.interactions(spark, d))


@query(f"with {BIG} select count(distinct user_id) num_users, count(distinct item_id) num_items, count(*) num_rows, min(sec) first_sec, max(sec) last_sec, 5::bigint min_user, 5::bigint min_item from big")
def dataset_metadata(spark: SparkSession, d: str) -> DataFrame:
    return P.metadata(T.ratings_big(spark, d))


# --- features --------------------------------------------------------------------------------


_USER_RATIOS = ", ".join(f"round(avg(case when rating >= {k - 0.5} and rating < {k + 0.5} then 1.0 else 0.0 end), 6) rating_{k}_ratio" for k in range(1, 6))
_ITEM_RATIOS = ", ".join(f"round(avg(case when rating > {0.0 if k == 1 else k - 0.5} and rating <= {k + 0.5} then 1.0 else 0.0 end), 6) rating_{k}_ratio" for k in range(1, 6))
_RATIOS = [f"rating_{k}_ratio" for k in range(1, 6)]


@query(f"""with {INTER} select user_id, count(*) rating_count, round(avg(rating), 6) rating_mean, round(coalesce(stddev_samp(rating), 0), 6) rating_std, min(rating) rating_min, max(rating) rating_max, {_USER_RATIOS},
 round(avg(hour(ts)), 6) avg_hour, round(avg(case when isodow(ts) >= 6 then 1.0 else 0.0 end), 6) weekend_ratio, round((max(sec) - min(sec)) / 86400.0, 6) activity_days, round(count(*) / greatest((max(sec) - min(sec)) / 86400.0, 1.0), 6) velocity from inter group by user_id""")
def user_stats(spark: SparkSession, d: str) -> DataFrame:
    s = X.user_stats(T.interactions(spark, d))
    return s.select("user_id", "rating_count", *_r("rating_mean", "rating_std"), "rating_min", "rating_max", *_r(*_RATIOS, "avg_hour", "weekend_ratio", "activity_days", "velocity"))


@query(f"with {INTER}, {MOVIES}, g as (select item_id, unnest(string_split(genres, '|')) genre from movies) select user_id, genre, round(avg(rating), 6) affinity, count(*) n from inter join g using (item_id) where genre <> '(no genres listed)' group by user_id, genre")
def user_genre_affinity(spark: SparkSession, d: str) -> DataFrame:
    out = X.genre_affinity(T.interactions(spark, d), P.parse_movies(T.movies(spark, d)))
    return out.select("user_id", "genre", *_r("affinity"), "n")


@query(f"with {BIG} select item_id, count(*) rating_count, round(avg(rating), 6) rating_mean, round(coalesce(stddev_samp(rating), 0), 6) rating_std, min(rating) rating_min, max(rating) rating_max, count(distinct user_id) num_users from big group by item_id")
def item_stats(spark: SparkSession, d: str) -> DataFrame:
    s = X.item_stats(T.ratings_big(spark, d))
    return s.select("item_id", "rating_count", *_r("rating_mean", "rating_std"), "rating_min", "rating_max", "num_users")


@query(f"with {BIG} select item_id, {_ITEM_RATIOS} from big group by item_id")
def item_rating_dist(spark: SparkSession, d: str) -> DataFrame:
    return X.item_stats(T.ratings_big(spark, d)).select("item_id", *_r(*_RATIOS))


@query(f"with {BIG}, s as (select item_id, count(*) c from big group by item_id) select item_id, c rating_count, round((rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0) / count(*) over (), 6) popularity_percentile from s")
def popularity_percentile(spark: SparkSession, d: str) -> DataFrame:
    s = T.ratings_big(spark, d).groupBy("item_id").agg(F.count("*").alias("rating_count"))
    return X.popularity_percentile(s).select("item_id", "rating_count", *_r("popularity_percentile"))


@query(f"with {MOVIES} select item_id, 2024 - coalesce(cast(nullif(regexp_extract(title, '(\\d{{4}})', 1), '') as bigint), 2024) item_age from movies")
def item_age(spark: SparkSession, d: str) -> DataFrame:
    return X.item_age(P.parse_movies(T.movies(spark, d))).select("item_id", "item_age")


@query(f"with {MOVIES}, m as (select item_id, string_split(genres, '|') g from movies), v as (select distinct unnest(g) genre from m) select item_id, genre, cast(list_contains(g, genre) as bigint) flag from m, v")
def genre_multihot(spark: SparkSession, d: str) -> DataFrame:
    return X.genre_multihot(P.parse_movies(T.movies(spark, d)))


@query("""with tok as (select doc_id item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) term from documents),
 tf as materialized (select item_id, term, count(*) tf from tok group by all), terms as (select term, count(*) df, sum(tf) total from tf group by term order by total desc, term limit 1000),
 n as (select count(*) n from documents), w as (select item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) w from tf join terms using (term), n),
 l as (select item_id, sqrt(sum(w * w)) l from w group by item_id), f as (select term from terms order by term limit 50)
 select item_id, term, round(w / l, 6) weight from w join f using (term) join l using (item_id)""")
def tag_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return X.tfidf(T.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")).select("item_id", "term", *_r("weight"))


@query(f"""with {SCORED}, us as (select user_id, avg(rating) um, count(*) uc from inter group by user_id), its as (select item_id, avg(rating) im, count(*) ic from inter group by item_id), pairs as (select distinct user_id, item_id from inter)
 select p.user_id, p.item_id, score similarity, round(um, 6) user_mean, cast(uc as double) user_count, round(im, 6) item_mean, cast(ic as double) item_count from pairs p join scored s on s.user_id = p.user_id and s.item_id = p.item_id join us on us.user_id = p.user_id join its on its.item_id = p.item_id""")
def pairwise_features(spark: SparkSession, d: str) -> DataFrame:
    rows = T.interactions(spark, d)
    out = X.pairwise(rows.select("user_id", "item_id").distinct(), _users(spark, d), T.item_vectors(spark, d), X.user_stats(rows), X.item_stats(rows))
    return out.select("user_id", "item_id", *_r("similarity", "user_mean"), "user_count", *_r("item_mean"), "item_count")


# --- catalog ---------------------------------------------------------------------------------


@query(f"with {BIG} select item_id, count(*) vote_count, round(avg(rating), 6) vote_average from big group by item_id having count(*) >= 20 order by vote_count desc, item_id limit 500")
def popular_top500(spark: SparkSession, d: str) -> DataFrame:
    s = T.ratings_big(spark, d).groupBy("item_id").agg(F.count("*").alias("vote_count"), F.round(F.avg("rating"), 6).alias("vote_average"))
    return C.popular(s)


TYPED = "tg as (select cast(json_extract_string(props, '$.k') as bigint) item_id, event_type tag from events)"


@query(f"with {TYPED} select item_id, tag, n, r \"rank\" from (select item_id, tag, count(*) n, row_number() over (partition by item_id order by count(*) desc, tag) r from tg group by item_id, tag) where r <= 5")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return C.top_tags(T.read(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.col("event_type").alias("tag")))


@query(f"""with {MOVIES}, links as (select p_partkey item_id, case when p_partkey % 7 = 0 then null when p_partkey % 11 = 0 then 0 else p_partkey + 1000 end tmdb_id from part),
 details as (select doc_id + 1000 tmdb_id, text overview, lang from documents) select item_id, title, tmdb_id, coalesce(overview, '') overview, coalesce(lang, 'en') "language" from movies join links using (item_id) left join details using (tmdb_id) where tmdb_id is not null and tmdb_id <> 0""")
def catalog_build(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    links = p.select("item_id", F.when(F.col("item_id") % 7 == 0, None).when(F.col("item_id") % 11 == 0, 0).otherwise(F.col("item_id") + 1000).cast("long").alias("tmdb_id"))
    details = T.read(spark, d, "documents").select((F.col("doc_id") + 1000).alias("tmdb_id"), F.col("text").alias("overview"), F.col("lang").alias("language"))
    return C.enrich(T.movies(spark, d), links, details)


@query(f"with {CATALOG} select item_id, title, vote_count, round(vote_average, 6) vote_average from catalog where vote_count >= 50 order by round(vote_average, 6) desc, item_id limit 50")
def top50(spark: SparkSession, d: str) -> DataFrame:
    c = T.catalog(spark, d).select("item_id", "title", "vote_count", *_r("vote_average"))
    return C.top_rated(c, 50, 50)


@query(f"with {CATALOG} select item_id, title, round(vote_average, 6) vote_average from catalog where media_type = 'tv'")
def tv_list(spark: SparkSession, d: str) -> DataFrame:
    return C.by_media_type(T.catalog(spark, d)).select("item_id", "title", *_r("vote_average"))


@query(f"""with {CATALOG}, g as (select item_id, round(vote_average, 6) va, unnest(genres) genre from catalog), s as (select genre, count(*) "size", row_number() over (order by count(*) desc, genre) genre_rank from g group by genre)
 select genre, genre_rank, "size", r "rank", item_id from (select *, row_number() over (partition by genre order by va desc, item_id) r from g) join s using (genre) where r <= 20""")
def genre_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.genre_rows(T.catalog(spark, d).withColumn("vote_average", F.round("vote_average", 6)))


@query(f"with {CATALOG}, ids as (select distinct item_id + 150 item_id from inter) select item_id, coalesce(title, 'Movie #' || item_id) title, title is not null found from ids left join catalog using (item_id)")
def movie_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = T.interactions(spark, d).select((F.col("item_id") + 150).alias("item_id")).distinct()
    return C.lookup(ids, T.catalog(spark, d))


@query(f"with {CATALOG} select item_id, title from catalog where contains(lower(title), 'ring') order by item_id limit 5")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    return C.suggest(T.catalog(spark, d), "Ring")


@query(f"with {CATALOG} select media_type, original_language, count(*) n, cast(sum(case when \"year\" >= 1980 then 1 else 0 end) as bigint) recent from catalog group by all")
def media_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.media_counts(T.catalog(spark, d))


@query(f"""with {MOVIES}, t as (select item_id, case when item_id % 9 = 0 then 'Escape ' || title when item_id % 7 = 0 then tag_text || ' Escape' when item_id % 5 = 0 then tag_text else title end title from movies),
 r as (select distinct lower(p_name) "name" from part union select lower(title) from t where item_id % 63 = 0 or item_id % 70 = 0)
 select item_id, "name", 'rule' kind from t, r where (lower(title) = "name" or starts_with(lower(title), "name" || ' (')) and not contains(title, 'Escape')""")
def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    """Some titles hold the guard word, and some of these are rules themselves: none of them may match."""
    i, word = F.col("item_id"), F.lit("Escape")
    title = F.when(i % 9 == 0, F.concat_ws(" ", word, "title")).when(i % 7 == 0, F.concat_ws(" ", "tag_text", word)).when(i % 5 == 0, F.col("tag_text")).otherwise(F.col("title"))
    titles = T.movies(spark, d).select("item_id", title.alias("title"))
    named = titles.where("item_id % 63 = 0 or item_id % 70 = 0").select(F.lower("title").alias("name"))
    rules = T.read(spark, d, "part").select(F.lower("p_name").alias("name")).union(named).distinct().withColumn("kind", F.lit("rule"))
    return C.match_rules(titles, rules)


LINKS = "links as (select p_partkey item_id, case when p_partkey % 7 = 0 then null when p_partkey % 11 = 0 then 0 else p_partkey // 2 + 1000 end tmdb_id from part)"


@query(f"with {LINKS}, asked as (select distinct doc_id + 1000 tmdb_id from documents), low as (select tmdb_id, min(item_id) item_id from links where tmdb_id is not null group by tmdb_id) select tmdb_id, item_id from asked left join low using (tmdb_id)")
def external_id_lookup(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    links = T.read(spark, d, "part").select(i.alias("item_id"), F.when(i % 7 == 0, None).when(i % 11 == 0, 0).otherwise(F.floor(i / 2) + 1000).cast("long").alias("tmdb_id"))
    return C.by_external_id(links, T.read(spark, d, "documents").select((F.col("doc_id") + 1000).alias("tmdb_id")))


@query(f"with {DATES}, parts as (select item_id % 50 collection_id, item_id part_id, case when release_date = 'unknown' then null else release_date end release_date from dates) select c.part_id item_id, p.part_id, p.release_date, row_number() over (partition by c.part_id order by p.release_date nulls last, p.part_id) place from parts c join parts p using (collection_id) where c.part_id <> p.part_id")
def franchise_order(spark: SparkSession, d: str) -> DataFrame:
    parts = _dates(spark, d).select((F.col("item_id") % 50).alias("collection_id"), F.col("item_id").alias("part_id"), F.nullif(F.col("release_date"), F.lit("unknown")).alias("release_date"))
    return C.franchise(parts, parts.select(F.col("part_id").alias("item_id"), "collection_id"))


@query("""select p_partkey item_id, case when p_partkey % 4 = 0 then 'https://pics.example/' || p_partkey || '.jpg' when p_partkey % 4 = 1 then 'https://img.example/w500/' || p_partkey || '.jpg' when p_partkey % 4 = 2 then 'https://img.example/w500/alt' || p_partkey end url from part""")
def poster_urls(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    text, kind = i.cast("string"), i % 4
    poster = F.when(kind == 0, F.concat(F.lit("https://pics.example/"), text, F.lit(".jpg"))).when(kind == 1, F.concat(F.lit("/"), text, F.lit(".jpg"))).when(kind == 2, "")
    path = F.when(kind == 2, F.concat(F.lit("/alt"), text)).when(kind == 0, "/unused")
    return T.read(spark, d, "part").select(i.alias("item_id"), C.poster_url(poster, path, "https://img.example").alias("url"))


# --- search and chat -------------------------------------------------------------------------


def _search_sql(q: str, expanded: list[str], language: str | None = None, genres: tuple = (), years: tuple | None = None, limit: int = 20) -> str:
    inside = ", ".join(f"'{x}'" for x in expanded)
    wanted = ", ".join(f"'{g.lower()}'" for g in genres)
    extra = f" + 40 * (select count(distinct lower(g)) from (select unnest(genres) g) where lower(g) in ({wanted}))" if genres else ""
    extra += f" + case when coalesce(\"year\", 0) between {years[0]} and {years[1]} then 30 else 0 end" if years else ""
    lang = f"case when original_language = '{language}' then 100 else 0 end + " if language else ""
    return f"""with {CATALOG}, s as (select item_id, title, {lang}case when lower(title) = '{q}' then 100 when contains(lower(title), '{q}') then 50 else 0 end
 + coalesce(list_sum(list_transform(tags, lambda t: case when t = '{q}' then 30 when contains(t, '{q}') then 20 when contains('{q}', t) and length(t) > 2 then 25 else 0 end)), 0)
 + coalesce(list_sum(list_transform(tags, lambda t: case when list_contains([{inside}], t) then 15 else 0 end)), 0)
 + coalesce(list_sum(list_transform(genres, lambda g: case when contains('{q}', lower(g)) then 20 else 0 end)), 0){extra} score from catalog)
 select item_id, title, cast(score as bigint) score from s where score > 0 order by score desc, item_id limit {limit}"""


@query(_search_sql("ring", ["ring"]))
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    return S.search(T.catalog(spark, d), "ring")


@query(_search_sql("economy brand#21 ring", ["economy", "brand#21", "ring"]))
def search_genre(spark: SparkSession, d: str) -> DataFrame:
    return S.search(T.catalog(spark, d), "Economy Brand#21 ring")


@query(_search_sql("hindi english ring", ["hindi", "english", "ring", "bollywood", "india", "indian"], "en"))
def search_two_languages(spark: SparkSession, d: str) -> DataFrame:
    return S.search(T.catalog(spark, d), "Hindi english ring")


@query(_search_sql("hindi ring", ["hindi", "ring", "bollywood", "india", "indian"], "hi"))
def search_language(spark: SparkSession, d: str) -> DataFrame:
    return S.search(T.catalog(spark, d), "Hindi ring")


@query(_search_sql("tiny widget", ["tiny", "widget"], None, ("ECONOMY", "Brand#2"), (1960, 1979)))
def search_intent(spark: SparkSession, d: str) -> DataFrame:
    return S.search(T.catalog(spark, d), "tiny widget", intent={"genres": ["ECONOMY", "Brand#2"], "year_min": 1960, "year_max": 1979})


_ASKED = """asked as (select p_partkey query_id, lower(trim(case p_partkey % 5 when 0 then p_name when 1 then split_part(p_name, ' ', 1) || ' ' || p_type when 2 then 'Hindi ' || split_part(p_name, ' ', 2) when 3 then 'sci-fi ' || p_brand || ' french' else split_part(p_name, ' ', 2) end)) q,
 case when p_partkey % 4 = 0 then [lower(p_type), lower(p_brand)] else [] end wanted, case when p_partkey % 3 = 0 then 1950 + p_size end lo, case when p_partkey % 6 = 0 then 1960 + p_size end hi from part)"""
_SYNONYM_MAP = "map {" + ", ".join(f"'{w}': [{', '.join(map(repr, more))}]" for w, more in S.SYNONYMS.items()) + "}"
_LANGUAGE_OF = "case " + " ".join(f"when contains(q, '{w}') then '{code}'" for w, code in S.LANGUAGES.items()) + " end"


@query(f"""with {CATALOG}, {_ASKED}, w as (select *, string_split(q, ' ') w from asked),
 e as (select query_id, q, {_LANGUAGE_OF} lang, list_distinct(flatten(list_transform(w, lambda x: list_concat([x], coalesce(({_SYNONYM_MAP})[x], []))))) expanded, case when len(w) > 1 then wanted else [] end wanted, case when len(w) > 1 then lo end lo, hi from w),
 s as (select query_id, item_id, title, case when original_language = lang then 100 else 0 end + case when lower(title) = q then 100 when contains(lower(title), q) then 50 else 0 end
 + coalesce(list_sum(list_transform(tags, lambda t: case when t = q then 30 when contains(t, q) then 20 when contains(q, t) and length(t) > 2 then 25 else 0 end)), 0)
 + coalesce(list_sum(list_transform(tags, lambda t: case when list_contains(expanded, t) then 15 else 0 end)), 0)
 + coalesce(list_sum(list_transform(genres, lambda g: case when contains(q, lower(g)) then 20 else 0 end)), 0)
 + 40 * len(list_intersect(list_distinct(list_transform(genres, lambda g: lower(g))), wanted))
 + case when lo is null then 0 when hi is null then case when coalesce("year", 0) >= lo then 15 else 0 end when coalesce("year", 0) between lo and hi then 30 else 0 end score from e, catalog)
 select query_id, item_id, title, score::bigint score, "rank" from (select *, row_number() over (partition by query_id order by score desc, item_id) "rank" from s where score > 0) where "rank" <= 20""")
def search_table(spark: SparkSession, d: str) -> DataFrame:
    """A query for each part, with languages, synonyms, genres and years among them, all in one plan."""
    i, word = F.col("p_partkey"), lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    text = F.when(i % 5 == 0, F.col("p_name")).when(i % 5 == 1, F.concat_ws(" ", word(1), "p_type")).when(i % 5 == 2, F.concat_ws(" ", F.lit("Hindi"), word(2)))
    text = text.when(i % 5 == 3, F.concat_ws(" ", F.lit("sci-fi"), "p_brand", F.lit("french"))).otherwise(word(2))
    year = F.col("p_size").cast("long")
    q = T.read(spark, d, "part").select(i.alias("query_id"), text.alias("query"), F.when(i % 4 == 0, F.array("p_type", "p_brand")).alias("genres"), F.when(i % 3 == 0, 1950 + year).alias("year_min"), F.when(i % 6 == 0, 1960 + year).alias("year_max"))
    return S.search_all(T.catalog(spark, d), q)


@query(f"""with {CATALOG}, c as (select c.*, coalesce(d.text, '') overview, [s_name] "cast" from catalog c left join documents d on d.doc_id = c.item_id join supplier on s_suppkey = c.item_id % 10 + 1)
 , s as (select item_id, title, case when title <> '' and contains('bollywood the', lower(title)) then 150 else 0 end + case when contains(lower(title), 'bollywood the') then 50 else 0 end + case when lower(title) = 'bollywood the' then 100 else 0 end
 + list_sum(list_transform("cast", lambda x: case when contains('bollywood the', lower(x)) then 40 else 0 end)) + list_sum(list_transform(genres, lambda g: case when contains('bollywood the', lower(g)) then 20 else 0 end))
 + case when contains(lower(overview), 'bollywood the') then 10 else 0 end + case when original_language = 'hi' then 30 else 0 end score from c)
 select item_id, title, cast(score as bigint) score from s where score > 0 order by score desc, item_id limit 5""")
def chat_search(spark: SparkSession, d: str) -> DataFrame:
    c = T.catalog(spark, d)
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("overview"))
    names = T.read(spark, d, "supplier").select((F.col("s_suppkey") - 1).alias("_k"), F.array("s_name").alias("cast"))
    c = c.join(docs, "item_id", "left").withColumn("overview", F.coalesce("overview", F.lit(""))).withColumn("_k", F.col("item_id") % 10).join(names, "_k")
    return S.chat_search(c, "bollywood the")


@query(f"""with {CATALOG}, c as (select c.*, coalesce(d.text, '') overview, [s_name] "cast" from catalog c left join documents d on d.doc_id = c.item_id join supplier on s_suppkey = c.item_id % 10 + 1),
 asked as (select s_suppkey query_id, lower(case s_suppkey % 4 when 0 then s_name || ' in a bollywood film' when 1 then p_name || ' (' || cast(1950 + p_size as varchar) || ') or ' || p_type when 2 then split_part(p_name, ' ', 1) else left(coalesce(text, 'x'), 4) end) q from supplier join part on p_partkey = s_suppkey left join documents on doc_id = s_suppkey),
 s as (select query_id, item_id, title, case when title <> '' and contains(q, lower(title)) then 150 else 0 end + case when contains(lower(title), q) then 50 else 0 end + case when lower(title) = q then 100 else 0 end
 + list_sum(list_transform("cast", lambda x: case when contains(q, lower(x)) then 40 else 0 end)) + list_sum(list_transform(genres, lambda g: case when contains(q, lower(g)) then 20 else 0 end))
 + case when contains(lower(overview), q) then 10 else 0 end + case when original_language = 'hi' and (contains(q, 'hindi') or contains(q, 'bollywood')) then 30 else 0 end score from asked, c)
 select query_id, item_id, title, score::bigint score, "rank" from (select *, row_number() over (partition by query_id order by score desc, item_id) "rank" from s where score > 0) where "rank" <= 5""")
def chat_search_table(spark: SparkSession, d: str) -> DataFrame:
    """A question for each supplier: names, titles, genres, words of titles, beginnings of overviews."""
    c = T.catalog(spark, d)
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("overview"))
    suppliers = T.read(spark, d, "supplier")
    names = suppliers.select((F.col("s_suppkey") - 1).alias("_k"), F.array("s_name").alias("cast"))
    c = c.join(docs, "item_id", "left").withColumn("overview", F.coalesce("overview", F.lit(""))).withColumn("_k", F.col("item_id") % 10).join(names, "_k")
    i = F.col("s_suppkey")
    text = F.when(i % 4 == 0, F.concat("s_name", F.lit(" in a Bollywood film"))).when(i % 4 == 1, F.concat("p_name", F.lit(" ("), (1950 + F.col("p_size")).cast("string"), F.lit(") or "), "p_type"))
    text = text.when(i % 4 == 2, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.substring(F.coalesce("overview", F.lit("x")), 1, 4))
    q = suppliers.join(T.read(spark, d, "part"), F.col("p_partkey") == i).join(docs, F.col("item_id") == i, "left").select(i.alias("query_id"), text.alias("query"))
    return S.chat_search_all(c, q)


@query(f"with {CATALOG}, g as (select array_agg(distinct p_type) t from part), s as (select item_id, title, round(vote_average + vote_count / 10000, 6) score from catalog, (select min(p_type) a from part) where list_has_any(list_transform(genres, lambda x: lower(x)), [lower(a)]) and coalesce(\"year\", 0) between 1955 and 1995) select * from s order by score desc, item_id limit 5")
def chat_filter_top5(spark: SparkSession, d: str) -> DataFrame:
    first = T.read(spark, d, "part").agg(F.min("p_type")).first()[0]
    return S.filter_top(T.catalog(spark, d), [first], 1955, 1995)


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) r from conversations) where r <= 2")
def chat_history_trim(spark: SparkSession, d: str) -> DataFrame:
    return S.trim_history(T.read(spark, d, "conversations").select("conv_id", "turn", "role", "text"), 2)


@query(f"""with {CATALOG} select c.item_id, '- ' || title || ' (' || coalesce(cast("year" as varchar), 'N/A') || ') [Cast: ' || s_name || ']: ' || left(coalesce(d.text, 'No description found'), 150) || '...' line from catalog c left join documents d on d.doc_id = c.item_id join supplier on s_suppkey = c.item_id % 10 + 1""")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("overview"))
    names = T.read(spark, d, "supplier").select((F.col("s_suppkey") - 1).alias("_k"), F.array("s_name").alias("cast"))
    c = T.catalog(spark, d).join(docs, "item_id", "left").withColumn("_k", F.col("item_id") % 10).join(names, "_k")
    return S.prompt_context(c)


_TURN = "case when t.turn % 3 = 0 then t.text || ' ' || lower(p_type) || ' please.' when t.turn % 3 = 1 then p_name || ' from the ' || cast(1950 + (p_size // 10) * 10 as varchar) || 's or ' || lower(p_brand) else t.text end"


@query(f"""with {CATALOG}, t as (select conv_id, t.turn, role, {_TURN} q from conversations t join part on p_partkey = t.conv_id % 100 + 1),
 hist as (select conv_id, least(count(*), 10) n_history from t group by conv_id), asked as (select conv_id, arg_max(q, turn) q from t where role = 'user' group by conv_id),
 g as (select distinct unnest(genres) genre from catalog), named as (select conv_id, list(lower(genre)) named from asked, g where contains(lower(q), lower(genre)) group by conv_id),
 intent as (select conv_id, cast(nullif(regexp_extract(q, '\\b(\\d{{3}})0s\\b', 1), '') as bigint) * 10 lo, coalesce(named, []) named from asked left join named using (conv_id)),
 fits as (select conv_id, item_id, round(vote_average + vote_count / 10000, 6) score from intent, catalog
 where (lo is null or coalesce("year", 0) between lo and lo + 9) and (len(named) = 0 or list_has_any(list_transform(genres, lambda x: lower(x)), named)))
 select conv_id, n_history, r "rank", item_id, score from (select *, row_number() over (partition by conv_id order by score desc, item_id) r from fits) join hist using (conv_id) where r <= 5""")
def chat_pipeline(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part")
    t = T.read(spark, d, "conversations").join(p, F.col("p_partkey") == F.col("conv_id") % 100 + 1)
    decade = F.concat(F.lit(" from the "), (1950 + F.floor(F.col("p_size") / 10) * 10).cast("string"), F.lit("s"))
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" "), F.lower("p_type"), F.lit(" please."))).when(F.col("turn") % 3 == 1, F.concat("p_name", decade, F.lit(" or "), F.lower("p_brand"))).otherwise(F.col("text"))
    return S.chat(t.select("conv_id", "turn", "role", text.alias("text")), T.catalog(spark, d))


@query("""with q as (select p_name || ' from the ' || cast(1950 + (p_size // 10) * 10 as varchar) || 's' query from part), v as (select distinct p_type t from part)
 select query, cast(nullif(regexp_extract(query, '\\b(\\d{3})0s\\b', 1), '') as bigint) * 10 year_min, cast(nullif(regexp_extract(query, '\\b(\\d{3})0s\\b', 1), '') as bigint) * 10 + 9 year_max,
 coalesce((select string_agg(t, '|' order by t) from v where contains(lower(query), lower(t))), '') genres from q""")
def intent_parse(spark: SparkSession, d: str) -> DataFrame:
    part = T.read(spark, d, "part")
    q = part.select(F.concat("p_name", F.lit(" from the "), (1950 + F.floor(F.col("p_size") / 10) * 10).cast("string"), F.lit("s")).alias("query"))
    return S.parse_intent(q, part.select(F.col("p_type").alias("term")).distinct())


@query("select event_id, regexp_extract('say: ' || props || ' end', '\\{.*\\}') json, cast(json_extract_string(regexp_extract('say: ' || props || ' end', '\\{.*\\}'), '$.k') as bigint) k from events")
def json_from_text(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_id", F.concat(F.lit("say: "), "props", F.lit("\n end")).alias("text"))
    return S.extract_json(e).select("event_id", "json", "k")


# --- vectors ---------------------------------------------------------------------------------


@query(f"with {SCORED} select user_id, item_id, score, r \"rank\" from ranked where r <= 10")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return R.knn(_users(spark, d), T.item_vectors(spark, d), "user_id", 10)


SIMILAR = f"{VECTORS}, pairs as (select a.item_id query_id, b.item_id, round({DOT.format(a='a.v', b='b.v')}, 6) score from vec a, vec b where a.item_id <> b.item_id), near as (select *, row_number() over (partition by query_id order by score desc, item_id) r from pairs)"


@query(f"with {SIMILAR} select query_id, item_id, score, r \"rank\" from near where r <= 10")
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    return R.similar_items(T.item_vectors(spark, d), 10)


@query(f"with {SIMILAR}, known as (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) k from near semi join part on p_partkey = item_id where r <= 50) select query_id, item_id, score, k \"rank\" from known where k <= 10")
def similar_items_catalog(spark: SparkSession, d: str) -> DataFrame:
    return R.similar_in_catalog(T.item_vectors(spark, d), T.movies(spark, d), 10)


RECOMMEND = f"""{SCORED}, c as (select * from ranked where r <= 100), s as (select distinct user_id, item_id from inter), f as (select c.user_id, c.item_id, c.score, row_number() over (partition by c.user_id order by c.score desc, c.item_id) k from c anti join s on s.user_id = c.user_id and s.item_id = c.item_id)"""


@query(f"with {RECOMMEND} select user_id, item_id, score, k \"rank\", 100::bigint num_candidates from f where k <= 10")
def recommend_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.recommend(_users(spark, d), T.item_vectors(spark, d), T.interactions(spark, d), 10)


@query(f"with {RECOMMEND}, known as (select distinct user_id from uvec), ask as (select distinct user_id from inter where user_id % 20 = 0 union select 999999) select ask.user_id, item_id, score, k \"rank\", case when known.user_id is null then 'User not found' end error from ask left join known on known.user_id = ask.user_id left join (select * from f where k <= 20) f on f.user_id = ask.user_id")
def batch_recommend(spark: SparkSession, d: str) -> DataFrame:
    rows = T.interactions(spark, d)
    ask = rows.where("user_id % 20 = 0").select("user_id").unionByName(spark.range(999999, 1000000).withColumnRenamed("id", "user_id"))
    return R.recommend_for(ask, _users(spark, d), T.item_vectors(spark, d), rows, 20)


@query(f"with {VECTORS}, i as (select item_id, row_number() over (order by item_id) - 1 x from vec) select item_id, x // 128 batch, x % 128 place, round(list_sum(v), 6) total from i join vec using (item_id)")
def embedding_export(spark: SparkSession, d: str) -> DataFrame:
    v = T.item_vectors(spark, d)
    out = R.batched(v.select("item_id"), v, 128)
    return out.select("item_id", "batch", "place", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _made(layer: int, rows: int, width: int) -> tuple[list[list[float]], list[float]]:
    """Weights that SQL can state too."""
    return [[((7 * i + 3 * j + 5 * layer) % 11 - 5) / 10 for j in range(width)] for i in range(rows)], [((i + layer) % 5 - 2) / 10 for i in range(rows)]


_LAYERS = {"stats": _made(0, 4, 2), "block_0.fc1": _made(1, 10, 12), "block_0.fc2": _made(2, 6, 10), "block_0.residual": _made(3, 6, 12), "block_0.norm": ([[1.1, 0.9, 1.0, 1.2, 0.8, 1.0]], [0.1, -0.1, 0.0, 0.2, 0.0, 0.1]), "output": _made(4, 4, 6)}


def _dense_sql(name: str, x: str) -> str:
    matrix, bias = _LAYERS[name]
    return f"list_transform(range(1, {len(bias) + 1}), lambda i: list_dot_product(({matrix})[i]::double[], {x}) + ({bias})[i])"


_ERF = "(2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: (case when n % 2 = 0 then 1 else -1 end) * exp((2 * n + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(n + 1)) / (2 * n + 1))) * sign({x}))"


@query(f"""with {VECTORS}, {INTER}, st as (select item_id, [avg(rating) / 5, ln(count(*))]::double[] st from inter group by item_id), a as (select item_id, list_concat(v[1:8], {_dense_sql("stats", "st")})::double[] x from vec join st using (item_id)),
 b as (select item_id, x, {_dense_sql("block_0.fc1", "x")} h from a), c as (select item_id, x, list_transform(h, lambda z: z * 0.5 * (1 + {_ERF.format(x="(z / sqrt(2))")})) h from b),
 d as (select item_id, list_transform(range(1, 7), lambda i: ({_dense_sql("block_0.fc2", "h").replace("lambda i", "lambda q").replace("[i]", "[q]")})[i] + ({_dense_sql("block_0.residual", "x").replace("lambda i", "lambda q").replace("[i]", "[q]")})[i]) y from c),
 e as (select item_id, list_transform(y, lambda z: z - list_avg(y)) y from d), f as (select item_id, list_transform(range(1, 7), lambda i: y[i] / sqrt(list_dot_product(y, y) / 6 + 1e-5) * ({_LAYERS["block_0.norm"][0][0]})[i] + ({_LAYERS["block_0.norm"][1]})[i])::double[] y from e),
 g as (select item_id, {_dense_sql("output", "y")} o from f) select item_id, i "component", round(o[i] / sqrt(list_dot_product(o, o)), 6) "value" from g, (select unnest(range(1, 5)) i)""")
def item_tower(spark: SparkSession, d: str) -> DataFrame:
    """A small item tower over given weights: an embedding, projected statistics, one block, the output."""
    stats = T.interactions(spark, d).groupBy("item_id").agg(F.array(F.avg("rating") / 5, F.log(F.count("*").cast("double"))).alias("stats"))
    weights = spark.createDataFrame(W.weight_rows(_LAYERS), "layer string, row int, values array<double>")
    embeddings = T.item_vectors(spark, d).select("item_id", F.slice("v", 1, 8).alias("embedding"))
    out = W.forward(stats, "item_id", W.Tower(("embedding", "stats"), ("stats",)), weights, embeddings)
    return out.select("item_id", F.posexplode("v").alias("p", "x")).select("item_id", (F.col("p") + 1).cast("long").alias("component"), F.round("x", 6).alias("value"))


@query("select vec_id item_id, i \"place\", embedding[i + 1]::double \"value\" from embeddings, (select unnest(range(64)) i)")
def vectors_npy(spark: SparkSession, d: str) -> DataFrame:
    """All vectors written to numpy files and read again, in ranges of 100 rows."""
    path = shared_path(spark)
    NP.write_vectors(T.item_vectors(spark, d), path)
    return NP.read_vectors(spark, path, 100).select("item_id", F.posexplode("v").alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query(f"with {INTER}, w as (select date_trunc('week', ts) w, user_id, item_id from inter) select strftime(w, '%Y-%m-%d') \"week\", count(distinct user_id) users, count(distinct user_id * 1000 + item_id) pairs, true close from w group by w")
def distinct_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users and pairs by week, exactly, and whether merged sketches of the days come within 5 percent."""
    rows = T.interactions(spark, d).withColumn("pair", F.struct("user_id", "item_id"))
    days = stored(X.daily_sketches(rows, {"users": F.col("user_id"), "pairs": F.xxhash64("user_id", "item_id")}))
    week = F.date_trunc("week", F.col("ts").cast("timestamp"))
    merged = X.merged_sketches(days, F.date_trunc("week", F.col("day").cast("timestamp")).alias("w"), ["users", "pairs"])
    exact = rows.groupBy(week.alias("w")).agg(F.countDistinct("user_id").alias("users"), F.countDistinct("pair").alias("pairs"))
    near = lambda c: F.abs(F.col(f"{c}_about") - F.col(c)) <= F.greatest(0.05 * F.col(c), F.lit(1.0))
    return exact.join(merged, "w").select(F.date_format("w", "yyyy-MM-dd").alias("week"), "users", "pairs", (near("users") & near("pairs")).alias("close"))


@query("with h as (select vec_id item_id, md5(vec_id::varchar) h from embeddings) select item_id from h order by h, item_id limit 200")
def training_subset(spark: SparkSession, d: str) -> DataFrame:
    return R.training_subset(T.item_vectors(spark, d), 200).select("item_id")


@query(f"""with {VECTORS}, idx as (select unnest(range(1, 65)) i), l as (select item_id, i - 1 i, v[i] x from vec, idx), e as (select i, min(x) lo, (max(x) - min(x)) / 255 st from l group by i)
 select item_id, i::bigint i, cast(floor((x - lo) / st + 0.5) as bigint) code from l join e using (i)""")
def sq8_codes(spark: SparkSession, d: str) -> DataFrame:
    return R.sq8_codes(T.item_vectors(spark, d)).select("item_id", F.col("i").cast("long").alias("i"), "code")


@query(f"""with {USERS}, l as (select item_id, i, v[i] x from vec, idx), e as (select i, min(x) lo, (max(x) - min(x)) / 255 st from l group by i),
 dec as (select item_id, list(lo + cast(floor((x - lo) / st + 0.5) as bigint) * st order by i) v from l join e using (i) group by item_id),
 s as (select user_id, item_id, round({DOT.format(a='uvec.v', b='dec.v')}, 6) score from uvec, dec), k as (select *, row_number() over (partition by user_id order by score desc, item_id) r from s)
 select user_id, item_id, score, r "rank" from k where r <= 10""")
def sq8_search(spark: SparkSession, d: str) -> DataFrame:
    return R.sq8_search(_users(spark, d), T.item_vectors(spark, d), "user_id", 10)


def _queries(spark, d):
    """The users whose id is divisible by 20, the stated queries of searches."""
    return R.user_vectors(T.interactions(spark, d).where("user_id % 20 = 0"), T.item_vectors(spark, d))


def _ivf(spark, d):
    items = T.item_vectors(spark, d)
    return items, R.ivf_build(items, R.auto_cells(items.count()))


@query()
def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    """With as many probes as reach a recall of 0.95 on the queries."""
    items, index = _ivf(spark, d)
    probes, _ = R.ivf_tune(index, _queries(spark, d), items, "user_id", 10)
    return R.ivf_search(index, _queries(spark, d), "user_id", 10, probes)


@query(f"with {SCORED} select user_id, item_id, score, r \"rank\" from ranked where r <= 10 and user_id % 20 = 0")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A saved and loaded index, searched in all of its cells: the exact neighbours."""
    _, index = _ivf(spark, d)
    path = shared_path(spark)
    index.save(path)
    loaded = R.IvfIndex.load(spark, path)
    return R.ivf_search(loaded, _queries(spark, d), "user_id", 10, loaded.centres.count())


def _compressed(spark, d, kind="pq"):
    items = T.item_vectors(spark, d)
    return items, Z.build(items, R.auto_cells(items.count()), kind)


@query()
def pq_search(spark: SparkSession, d: str) -> DataFrame:
    """Residual product codes in the 16 nearest cells, the 200 best scored by their own vectors."""
    items, index = _compressed(spark, d)
    return Z.search(index, _queries(spark, d), items, "user_id", 10, 16, 200)


@query(f"with {SCORED} select user_id, item_id, score, r \"rank\" from ranked where r <= 10 and user_id % 20 = 0")
def pq_search_all(spark: SparkSession, d: str) -> DataFrame:
    """A saved and loaded index of product codes with all cells probed and all candidates scored by their own vectors: the exact neighbours."""
    items, index = _compressed(spark, d)
    path = shared_path(spark)
    index.save(path)
    loaded = Z.CompressedIndex.load(spark, path)
    return Z.search(loaded, _queries(spark, d), items, "user_id", 10, loaded.centres.count(), items.count())


@query()
def compressed_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 and bytes of codes by codec and number of probes, 100 candidates scored by their own vectors."""
    items, q, out = T.item_vectors(spark, d), stored(_queries(spark, d)), None
    exact = stored(R.knn(q, items, "user_id", 10))
    for kind in Z.CODECS:
        index = _compressed(spark, d, kind)[1]
        for probes in (4, 16):
            recall = R.recall_at_k(Z.search(index, q, items, "user_id", 10, probes), exact, "user_id", 10)
            row = recall.crossJoin(index.bytes_stored()).select(F.lit(kind).alias("codec"), F.lit(probes).cast("long").alias("probes"), F.round("recall", 6).alias("recall"), "code_bytes")
            out = row if out is None else out.unionByName(row)
    return out


def _graph_found(spark, d, queries):
    return G.search(G.build(T.item_vectors(spark, d)), queries, "user_id", 10)


@query()
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """By a saved and loaded neighbour graph."""
    path = shared_path(spark)
    G.build(T.item_vectors(spark, d)).save(path)
    return G.search(G.GraphIndex.load(spark, path), _queries(spark, d), "user_id", 10)


@query()
def lsh_search(spark: SparkSession, d: str) -> DataFrame:
    return R.lsh_search(_queries(spark, d), T.item_vectors(spark, d), "user_id", 10)


@query(f"""with {USERS}, n as (select floor(sqrt(count(*)))::bigint n from vec), c as (select item_id cell, v from vec, n where item_id < n), placed as (select v.item_id, arg_max(cell, ({DOT.format(a='v.v', b='c.v')} - {DOT.format(a='c.v', b='c.v')} / 2, -cell)) cell from vec v, c group by v.item_id),
 q as (select user_id, v from uvec where user_id % 20 = 0), near as (select user_id, cell, row_number() over (partition by user_id order by {DOT.format(a='q.v', b='c.v')} desc, cell) probes from q, c),
 t as (select user_id, item_id from (select user_id, item_id, row_number() over (partition by user_id order by round({DOT.format(a='q.v', b='vec.v')}, 6) desc, item_id) r from q, vec) where r <= 10),
 f as (select probes, count(*) m from t join placed using (item_id) join near using (user_id, cell) group by probes) select probes, round(sum(m) over (order by probes) / sum(m) over (), 6) recall from f""")
def ivf_recall_given(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 by number of probes, over cells around given centroids: the first vectors."""
    items = T.item_vectors(spark, d)
    centres = items.where(F.col("item_id") < R.auto_cells(items.count())).select(F.col("item_id").cast("int").alias("cell_id"), F.col("v").alias("c"))
    curve = R.ivf_tune(R.ivf_around(items, centres), _queries(spark, d), items, "user_id", 10)[1]
    return curve.select(F.col("probes").cast("long").alias("probes"), *_r("recall"))


@query()
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 by number of probes, and of product codes and projections (probes null)."""
    items, index = _ivf(spark, d)
    q = stored(_queries(spark, d))
    out = R.ivf_tune(index, q, items, "user_id", 10)[1].select(F.lit("ivf").alias("index"), F.col("probes").cast("long").alias("probes"), "recall")
    exact = stored(R.knn(q, items, "user_id", 10))
    compressed = _compressed(spark, d)[1]
    for name, found in (("pq", Z.search(compressed, q, items, "user_id", 10, 16, 200)), ("graph", _graph_found(spark, d, q)), ("lsh", R.lsh_search(q, items, "user_id", 10))):
        out = out.unionByName(R.recall_at_k(found, exact, "user_id", 10).select(F.lit(name).alias("index"), F.lit(None).cast("long").alias("probes"), "recall"))
    return out


SIZES = "sizes as (select count(*) n from part union all select count(*) from orders union all select count(*) * 100 from lineitem union all select count(*) from embeddings)"


def _sizes(spark, d):
    count = lambda t, k=1: T.read(spark, d, t).agg((F.count("*") * k).alias("n"))
    return count("part").union(count("orders")).union(count("lineitem", 100)).union(count("embeddings"))


@query(f"with {SIZES} select n, case when n < 10000 then 'flat' when n < 100000 then 'ivf_flat' else 'ivf_pq' end kind, cast(floor(sqrt(n)) as bigint) nlist, case when n < 1000000 then 32 else 64 end::bigint nprobe, case when n < 1000000 then 8 else 16 end::bigint m from sizes")
def index_autoconfig(spark: SparkSession, d: str) -> DataFrame:
    return R.index_config(_sizes(spark, d))


@query(f"with {SIZES} select n, cast(n as double) * 256 / 1e6 flat_mb, cast(n as double) * 8 / 1e6 pq_mb from sizes")
def index_memory(spark: SparkSession, d: str) -> DataFrame:
    return R.index_memory(_sizes(spark, d))


@query("with r as (select s_name \"name\", (s_suppkey * 7 % 20) / 20.0 recall, (s_suppkey * 13 % 50) / 10.0 latency_ms from supplier) select * from r order by case when recall >= 0.95 then 0 else 1 end, latency_ms, recall desc, \"name\" limit 1")
def select_best_index(spark: SparkSession, d: str) -> DataFrame:
    r = T.read(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 7 % 20 / 20.0).alias("recall"), (F.col("s_suppkey") * 13 % 50 / 10.0).alias("latency_ms"))
    return R.select_best(r)


# --- re-ranking ------------------------------------------------------------------------------


RULES = f"{SCORED}, c as (select user_id, item_id, score from ranked where r <= 100), s as (select distinct user_id, item_id from inter), ruled as (select c.* from c anti join s on s.user_id = c.user_id and s.item_id = c.item_id where c.item_id not in (3, 7, 250) union all select user_id, item_id, 999.0 from c where item_id in (3, 7, 250))"


@query(f"with {RULES} select user_id, item_id, score, row_number() over (partition by user_id order by case when score = 999.0 then list_position([250, 3, 7], item_id) end nulls last, score desc, item_id) \"rank\" from ruled")
def business_rules(spark: SparkSession, d: str) -> DataFrame:
    return K.business_rules(_lists(spark, d).drop("rank"), T.interactions(spark, d), [250, 3, 7])


@query(f"with {SCORED}, c as (select user_id, item_id, score, case when item_id % 10 = 0 then 'tv' else 'movie' end category from ranked where r <= 100), q as (select *, row_number() over (partition by user_id, category order by score desc, item_id) p from c) select user_id, item_id, score, category from q where p <= case category when 'tv' then 2 else 5 end")
def category_quota(spark: SparkSession, d: str) -> DataFrame:
    c = _lists(spark, d).drop("rank").withColumn("category", F.when(F.col("item_id") % 10 == 0, "tv").otherwise("movie"))
    return K.category_quota(c, {"tv": 2}, 5)


@query(f"with {SCORED} select user_id, item_id, round(score + least(greatest(0.2 * exp(-(item_id % 400) / 90.0), 0.0), 0.2), 6) score from ranked where r <= 100")
def freshness_boost(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("user_id", "item_id", F.round(K.freshness(F.col("score"), (F.col("item_id") % 400).cast("double")), 6).alias("score"))


@query(f"with {SCORED}, c as (select user_id, item_id, score, min(score) over (partition by user_id) lo, max(score) over (partition by user_id) hi from ranked where r <= 100) select user_id, item_id, round((score - lo) / (hi - lo + 1e-8), 6) scaled from c")
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("user_id", "item_id", F.round(K.min_max("score", "user_id"), 6).alias("scaled"))


@query(f"""with recursive {SCORED}, c as (select user_id, item_id, (score - min(score) over (partition by user_id)) / (max(score) over (partition by user_id) - min(score) over (partition by user_id) + 1e-8) s, v from ranked join vec using (item_id) where r <= 50),
 sims as materialized (select a.user_id, a.item_id a, b.item_id b, {DOT.format(a='a.v', b='b.v')} x from c a join c b on a.user_id = b.user_id and a.item_id <> b.item_id),
 f as (select distinct user_id, 0 k, []::bigint[] done from c union all select user_id, k + 1, list_append(done, arg_min(item_id, (-value, -s, item_id))) from
 (select f.user_id, f.k, f.done, c.item_id, any_value(c.s) s, 0.7 * any_value(c.s) - 0.3 * coalesce(max(x), 0) value from f join c on c.user_id = f.user_id and not list_contains(f.done, c.item_id) left join sims on sims.user_id = c.user_id and sims.a = c.item_id and list_contains(f.done, sims.b) where f.k < 10 group by f.user_id, f.k, f.done, c.item_id)
 group by user_id, k, done)
 select user_id, i "rank", done[i] item_id from f, (select unnest(range(1, 11)) i) where k = 10""")
def mmr_rerank(spark: SparkSession, d: str) -> DataFrame:
    return K.mmr(_lists(spark, d, 50).join(T.item_vectors(spark, d), "item_id"), 10)


@query(f"with {RULES}, a as (select user_id, item_id, round(score + least(greatest(0.2 * exp(-(item_id % 400) / 90.0), 0.0), 0.2), 6) score from ruled) select user_id, item_id, score, k \"rank\" from (select *, row_number() over (partition by user_id order by score desc, item_id) k from a) where k <= 20")
def rerank_pipeline(spark: SparkSession, d: str) -> DataFrame:
    c = _lists(spark, d).drop("rank").withColumn("age_days", (F.col("item_id") % 400).cast("double"))
    return K.rerank(c, T.interactions(spark, d), [3, 7, 250], 20)


# --- evaluation ------------------------------------------------------------------------------


def _metric_sql(k: int) -> str:
    return f"""{SCORED}, truth as (select distinct user_id, item_id from inter where rating >= 4), g as (select user_id, count(*) g from truth group by user_id),
 l as (select r.user_id, r.item_id, r.r, case when t.item_id is null then 0 else 1 end hit from ranked r left join truth t on t.user_id = r.user_id and t.item_id = r.item_id where r.r <= 100),
 h as (select *, sum(hit) over (partition by user_id order by r rows unbounded preceding) found from l),
 s as (select user_id, sum(case when r <= {k} then hit / log2(r + 1) else 0 end) dcg, sum(case when r <= {k} then hit * found / r else 0 end) pr, sum(case when r <= {k} then hit else 0 end) nh, sum(case when r <= {k} then 1 else 0 end) nl, min(case when hit = 1 then r end) fr from h group by user_id),
 per as (select g.user_id, dcg / list_sum(list_transform(range(1, least(g, {k}) + 1), lambda i: 1 / log2(i + 1))) ndcg, pr / least(g, {k}) "map", coalesce(1.0 / fr, 0) mrr, nh / g recall, nh / nl "precision", case when nh > 0 then 1.0 else 0.0 end hit_rate from g join s using (user_id))"""


def _metric(name: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return M.per_user(_lists(spark, d), _truth(spark, d), 10).select("user_id", *_r(name))

    f.__name__ = name if name == "hit_rate" else {"map": "map_at_10", "ndcg": "ndcg_at_10", "recall": "recall_at_10", "precision": "precision_at_10"}.get(name, name)
    return query(f'with {_metric_sql(10)} select user_id, round("{name}", 6) "{name}" from per')(f)


for _name in ("ndcg", "map", "mrr", "recall", "precision", "hit_rate"):
    _metric(_name)


@query(f"""with {SCORED}, g as (select user_id, item_id, floor(avg(rating) - 0.5) g from inter group by all), l as (select r.user_id, r.item_id, r.r, coalesce(g, 0) g from ranked r left join g on g.user_id = r.user_id and g.item_id = r.item_id where r.r <= 100),
 p as (select *, pow(2, g) - 1 gain, row_number() over (partition by user_id order by g desc, item_id) i from l), s as (select user_id, sum(case when r <= 10 then gain / log2(r + 1) else 0 end) dcg, sum(case when i <= 10 then gain / log2(i + 1) else 0 end) ideal from p group by user_id)
 select user_id, round(dcg / ideal, 6) ndcg from s where ideal > 0""")
def ndcg_graded(spark: SparkSession, d: str) -> DataFrame:
    """Grades from 0 to 4 by the mean rating; items of the list without one have grade 0."""
    grade = T.interactions(spark, d).groupBy("user_id", "item_id").agg(F.floor(F.avg("rating") - 0.5).cast("double").alias("label"))
    lists = _lists(spark, d).join(grade, ["user_id", "item_id"], "left").fillna(0.0, ["label"])
    return L.ndcg(lists, "score").select("user_id", *_r("ndcg"))


_EVALUATED = " union all ".join(f"select '{m}' metric, {k}::bigint k, avg(\"{m}\") v from p{k}" for k in (10, 50, 100) for m in ("ndcg", "map", "recall", "precision", "hit_rate", "mrr") if m != "mrr" or k == 10)


@query(f"with {', '.join(f'p{k} as (with {_metric_sql(k)} select * from per)' for k in (10, 50, 100))} select metric, k, round(v, 6) \"value\" from ({_EVALUATED})")
def evaluate_all(spark: SparkSession, d: str) -> DataFrame:
    return M.evaluate(_lists(spark, d), _truth(spark, d), (10, 50, 100)).select("metric", "k", *_r("value"))


@query(f"with {SCORED}, n as (select count(*) n from vec) select round(count(distinct item_id) / any_value(n), 6) coverage from ranked, n where r <= 100")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage(_lists(spark, d), T.item_vectors(spark, d).count()).select(*_r("coverage"))


@query(f"with {SCORED}, t as (select user_id, r, v from ranked join vec using (item_id) where r <= 20) select a.user_id, round(avg(1 - {DOT.format(a='a.v', b='b.v')}), 6) ild from t a join t b on a.user_id = b.user_id and a.r < b.r group by a.user_id")
def ild(spark: SparkSession, d: str) -> DataFrame:
    return M.intra_list_diversity(_lists(spark, d, 20), T.item_vectors(spark, d)).select("user_id", *_r("ild"))


@query(f"with {SCORED}, n as (select count(*) n from inter), p as (select item_id, count(*) / any_value(n) p from inter, n group by item_id) select user_id, round(avg(-log2(coalesce(p, 1e-6) + 1e-10)), 6) novelty from ranked left join p using (item_id) where r <= 20 group by user_id")
def novelty(spark: SparkSession, d: str) -> DataFrame:
    return M.novelty(_lists(spark, d, 20), T.interactions(spark, d)).select("user_id", *_r("novelty"))


@query(f"with {SCORED}, truth as (select distinct user_id, item_id from inter where rating >= 4), t as (select * from truth) select round((select count(*) from t semi join (select * from ranked where r <= 100) x on x.user_id = t.user_id and x.item_id = t.item_id) / greatest((select count(*) from t), 1), 6) recall")
def micro_recall100(spark: SparkSession, d: str) -> DataFrame:
    return M.micro_recall(_lists(spark, d), _truth(spark, d), 100).select(*_r("recall"))


BATCH = f"{VECTORS}, n as (select count(*) n from vec), b as (select a.item_id id, a.v u, p.v v, q.v w from vec a, n join vec p on p.item_id = (a.item_id + 1) % n join vec q on q.item_id = (a.item_id + 7) % n)"


def _batch(spark, d):
    v = T.item_vectors(spark, d)
    n = v.count()
    near = lambda k, c: v.select((F.pmod(F.col("item_id") - k, F.lit(n))).alias("id"), F.col("v").alias(c))
    return v.select(F.col("item_id").alias("id"), F.col("v").alias("u")).join(near(1, "p"), "id").join(near(7, "n"), "id")


@query(f"with {VECTORS}, n as (select count(*) n from vec), b as (select a.item_id id, a.v u, p.v v from vec a cross join n join vec p on p.item_id = (a.item_id + 1) % n.n), l as (select x.id, y.id o, {DOT.format(a='x.u', b='y.v')} / 0.07 l from b x, b y), m as (select id, max(l) m, max(case when id = o then l end) own from l group by id), s as (select l.id, any_value(m.m) + ln(sum(exp(l.l - m.m))) lse, any_value(own) own from l join m on m.id = l.id group by l.id) select round(avg(lse - own), 6) loss from s")
def loss_infonce(spark: SparkSession, d: str) -> DataFrame:
    return M.info_nce(_batch(spark, d).select("id", "u", F.col("p").alias("v"))).select(*_r("loss"))


TRIPLES = f"{VECTORS}, n as (select count(*) n from vec), t as (select {DOT.format(a='a.v', b='p.v')} dp, {DOT.format(a='a.v', b='q.v')} dn from vec a cross join n join vec p on p.item_id = (a.item_id + 1) % n.n join vec q on q.item_id = (a.item_id + 7) % n.n)"


@query(f"with {TRIPLES} select round(avg(ln(1 + exp(-(dp - dn)))), 6) loss from t")
def loss_bpr(spark: SparkSession, d: str) -> DataFrame:
    return M.bpr(_batch(spark, d)).select(*_r("loss"))


@query(f"with {VECTORS}, n as (select count(*) n from vec), t as (select a.item_id id, {DOT.format(a='a.v', b='p.v')} dp, {DOT.format(a='a.v', b='q.v')} dn from vec a cross join n join vec p on p.item_id = (a.item_id + 1) % n.n join (select unnest([7, 11, 13]) o) o on true join vec q on q.item_id = (a.item_id + o.o) % n.n) select round(avg(l), 6) loss from (select ln(1 + sum(exp((dn - dp) / 0.07))) l from t group by id)")
def loss_sampled_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Three sampled negatives for each positive."""
    b = _batch(spark, d)
    v = T.item_vectors(spark, d)
    n = v.count()
    more = [b.select("id", "u", "p").join(v.select(F.pmod(F.col("item_id") - k, F.lit(n)).alias("id"), F.col("v").alias("n")), "id") for k in (11, 13)]
    return M.loss("sampled_softmax", b.select("id", "u", "p", "n").unionByName(more[0]).unionByName(more[1])).select(*_r("loss"))


LOGITS = f"{VECTORS}, n as (select count(*) n from vec), b as (select a.item_id id, a.v u, p.v v from vec a cross join n join vec p on p.item_id = (a.item_id + 1) % n.n), l as (select x.id, y.id o, {DOT.format(a='x.u', b='y.v')} s from b x, b y), own as (select id, s from l where id = o), hard as (select id, s, row_number() over (partition by id order by s desc) r from l where id <> o)"


@query(f"with {LOGITS} select round(avg(greatest(0.0, 0.2 + hard.s - own.s)), 6) loss from hard join own using (id) where r <= 10")
def loss_in_batch_hard(spark: SparkSession, d: str) -> DataFrame:
    return M.loss("in_batch_hard_negative", _batch(spark, d).select("id", "u", F.col("p").alias("v"))).select(*_r("loss"))


@query("with n as (select count(*) // 32 n from events), s as (select event_id // 32 step, count(*) rows from events group by 1) select step, rows, round(case when step < 10 then 0.001 * (step + 1) / 10 else 1e-6 + (0.001 - 1e-6) * 0.5 * (1 + cos(pi() * (step - 10) / greatest(1, n - 10))) end, 9) rate from s, n")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The rate of each batch of 32 events of one pass over them."""
    e = T.read(spark, d, "events")
    steps = F.lit(e.count() // 32)
    batches = e.groupBy(F.floor(F.col("event_id") / 32).alias("step")).agg(F.count("*").alias("rows"))
    return batches.select("step", "rows", F.round(M.learning_rate(F.col("step"), steps, 10, 0.001, 1e-6), 9).alias("rate"))


@query(f"with {TRIPLES} select round(avg(greatest(0.0, 0.2 + dn - dp)), 6) loss from t")
def loss_hard_negative(spark: SparkSession, d: str) -> DataFrame:
    return M.hard_negative(_batch(spark, d)).select(*_r("loss"))


MINED = f"""{VECTORS}, n as (select count(*) n from vec), b as (select a.item_id id, a.v u, p.v v, p.item_id pid from vec a cross join n join vec p on p.item_id = (a.item_id + 1) % n.n),
 l as (select x.id, y.id o, {DOT.format(a='x.u', b='y.v')} / 0.07 l from b x, b y), m as (select id, max(l) m, max(case when id = o then l end) own from l group by id), s as (select l.id, any_value(m.m) + ln(sum(exp(l.l - m.m))) - any_value(own) nll from l join m on m.id = l.id group by l.id),
 f as (select b.id, c.item_id, round({DOT.format(a='b.u', b='c.v')}, 6) s, pid, u, b.v, c.v w from b, vec c where c.item_id <> b.id), r as (select *, row_number() over (partition by id order by s desc, item_id) r from f),
 h as (select *, row_number() over (partition by id order by r) k from r where r <= 20 and item_id <> pid)"""


@query(f"with {MINED} select round((select avg(nll) from s) + 0.5 * (select avg(greatest(0.0, {DOT.format(a='u', b='w')} - {DOT.format(a='u', b='v')})) from h where k <= 5), 6) loss")
def loss_with_mined_negatives(spark: SparkSession, d: str) -> DataFrame:
    """In-batch loss plus half the margin over five negatives of each item, mined from a saved index with all cells probed."""
    items, index = _ivf(spark, d)
    path = shared_path(spark)
    index.save(path)
    loaded = R.IvfIndex.load(spark, path)
    n = items.count()
    batch = stored(_batch(spark, d).select("id", "u", F.col("p").alias("v")))
    right = batch.select("id", F.pmod(F.col("id") + 1, F.lit(n)).alias("item_id")).unionByName(batch.select("id", F.col("id").alias("item_id")))
    # one more than wanted, as an item finds itself
    found = R.ivf_search(loaded, batch.select("id", F.col("u").alias("v")), "id", 21, loaded.centres.count()).where("id <> item_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= 20)
    return M.with_hard_negatives(batch, M.mined_triples(batch, found, items, right)).select(*_r("loss"))


SERIES = "ordered as (select user_id series, row_number() over (partition by user_id order by ts, event_id) step, value from events)"


@query(f"""with recursive {SERIES}, f as (select series, step, value best, 0 waited, null::bigint stopped from ordered where step = 1
 union all select o.series, o.step, case when f.stopped is not null or o.value <= f.best + 0.5 then f.best else o.value end, case when f.stopped is not null then f.waited when o.value > f.best + 0.5 then 0 else f.waited + 1 end,
 case when f.stopped is not null then f.stopped when o.value <= f.best + 0.5 and f.waited + 1 >= 8 then o.step end from f join ordered o on o.series = f.series and o.step = f.step + 1)
 select series, max(step) steps, arg_max(stopped, step) stopped_at, max(best) best from f group by series""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """The values of each user's events as a series, with a patience of eight steps."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = T.read(spark, d, "events").select(F.col("user_id").alias("series"), step.cast("long").alias("step"), "value")
    return M.early_stopping(rows, 8, 0.5)


# --- learned substitutes ---------------------------------------------------------------------


@query()
def als_factors(spark: SparkSession, d: str) -> DataFrame:
    """Ids are any longs: the factorisation sees their dense indexes."""
    from pyspark.ml.recommendation import ALS

    rows = P.encode(T.interactions(spark, d).select("user_id", "item_id", "rating"))
    rows = rows.groupBy("user_id", F.col("user_idx").cast("int").alias("user"), F.col("item_idx").cast("int").alias("item")).agg(F.avg("rating").cast("float").alias("rating"))
    model = ALS(rank=16, maxIter=5, seed=1).fit(rows.select("user", "item", "rating"))
    return model.userFactors.join(rows.select("user_id", F.col("user").alias("id")).distinct(), "id").select("user_id", "features")


_RANK_FEATURES = ["similarity", "user_count", "user_mean", "item_count", "item_mean"]


def _ranking(spark, d):
    """Every user's items with a grade from 0 to 4 and features, of users to learn from and users held out.

    What is known of items comes from the users to learn from alone; a user's own means are no
    secret of the list's order.
    """
    rows = T.interactions(spark, d)
    known, _ = L.split_users(rows)
    grade = rows.groupBy("user_id", "item_id").agg(F.floor(F.avg("rating") - 0.5).cast("double").alias("label"))
    stats = X.pairwise(rows.select("user_id", "item_id").distinct(), _users(spark, d), T.item_vectors(spark, d), X.user_stats(rows), X.item_stats(known))
    return L.split_users(stored(stats.join(grade, ["user_id", "item_id"]).select("user_id", "item_id", "label", *_RANK_FEATURES)))


@query()
def lambdarank(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of each held-out user by a saved and loaded ranker that never saw these users."""
    train, held = _ranking(spark, d)
    path = shared_path(spark)
    L.train(train, _RANK_FEATURES, held).save(spark, path)
    scored = L.Ranker.load(spark, path).predict(held)
    return R.top_k(scored.select("user_id", "item_id", F.round("prediction", 9).alias("score")), "user_id", 10)


@query()
def recommend_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval, then the ranker, then rules and freshness: the best 20 of each held-out user's 100 nearest items."""
    rows = T.interactions(spark, d)
    known, asked = L.split_users(rows)
    train, held = _ranking(spark, d)
    model = L.train(train, _RANK_FEATURES, held)
    users = _users(spark, d).join(asked.select("user_id").distinct(), "user_id", "left_semi")
    found = stored(R.knn(users, T.item_vectors(spark, d), "user_id", 100).select("user_id", "item_id"))
    features = X.pairwise(found, users, T.item_vectors(spark, d), X.user_stats(asked), X.item_stats(known))
    scored = model.predict(features).select("user_id", "item_id", F.round("prediction", 9).alias("score"), (F.col("item_id") % 400).cast("double").alias("age_days"))
    return K.rerank(scored, rows, [250, 3, 7], 20)


@query()
def lambdarank_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """NDCG at 10 on held-out users, of the ranker's order and of the order by similarity, and the share of the gain of each feature."""
    train, held = _ranking(spark, d)
    model = L.train(train, _RANK_FEATURES, held)
    scored = model.predict(held)
    mean = lambda c: L.ndcg(scored, c).agg(F.avg("ndcg").alias("value")).select(F.lit(f"ndcg_{c}").alias("name"), "value")
    return mean("prediction").unionByName(mean("similarity")).unionByName(model.importances(spark).select(F.concat(F.lit("gain_"), "feature").alias("name"), F.col("gain").alias("value")))


# --- streaming -------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = T.read(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return source.withColumn("item_id", F.get_json_object("props", "$.k").cast("long"))


_ST = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


#: What the watermark has passed when the stream has been read: the latest event, less the hour that rows may be late.
_MARK = "(select date_trunc('millisecond', max(ts)) - interval 1 hour from events)"


@query(f"with w as (select time_bucket(interval 1 hour, ts) st, event_type from events) select {_ST.format(c='st')} \"start\", event_type, count(*) n from w group by all")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return _text(E.drain_to_end(_stream(spark, d), E.tumbling_counts), "start")


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


@query(f"with {INTER}, w as (select time_bucket(interval 1 hour, ts) - h * interval 1 hour st, item_id from inter, (select unnest(range(6)) h)) select {_ST.format(c='st')} \"start\", item_id, count(*) n from w group by all")
def stream_trending_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _text(E.drain_to_end(_stream(spark, d), E.sliding_trend), "start")


_SESSIONS = "o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end f from events), g as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) s from o), ss as (select user_id, min(ts) a, max(ts) b, count(*) n from g group by user_id, s)"


@query(f"with {_SESSIONS} select user_id, {_ST.format(c='a')} \"start\", {_ST.format(c='b + interval 30 minutes')} \"end\", n from ss")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _text(E.drain_to_end(_stream(spark, d), E.sessions), "start", "end")


_MS = "(select user_id, time_bucket(interval 1 millisecond, ts) ts from events)"


@query(f"with {_SESSIONS.replace('from events)', f'from {_MS})')} select user_id, epoch_ms(a)::bigint start_ms, epoch_ms(b)::bigint last_ms, n from ss where b + interval 30 minutes <= {_MARK}")
def stream_sessions_timed(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions by keyed state with timers, to the millisecond."""
    with E.with_state_store(spark):
        return E.drain(E.timed_sessions(_stream(spark, d))).withColumnRenamed("key", "user_id")


@query("""with m as (select min(ts) a, max(ts) b from events), e as (select event_id, ts, case when event_id % 50 = 0 then 3 else least(3, floor(4 * (epoch(ts) - epoch(a)) / (epoch(b) - epoch(a)))::int) end part from events, m),
 marks as (select part, (select max(ts) from e x where x.part < y.part) - interval 1 hour mark from (select distinct part from e) y)
 select event_id, part::bigint batch, coalesce(ts < mark, false) late from e join marks using (part)""")
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Four batches in order of time, to the last of which one event in fifty comes late: every event is in one of the two tables."""
    e, path = T.read(spark, d, "events"), shared_path(spark)
    ends = e.agg(F.min("ts"), F.max("ts")).first()
    at = lambda x: F.expr(f"unix_micros(cast({x} as timestamp))")
    low, high = F.lit(ends[0]).cast("timestamp"), F.lit(ends[1]).cast("timestamp")
    rows = e.withColumn("lo", low).withColumn("hi", high)
    part = F.when(F.col("event_id") % 50 == 0, 3).otherwise(F.least(F.lit(3), F.floor(4 * (at("ts") - at("lo")) / (at("hi") - at("lo"))).cast("int")))
    for k in range(4):
        rows.where(part == k).select(*e.columns).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    in_time, late = E.split_late(stream)
    return in_time.select("event_id", "batch", F.lit(False).alias("late")).unionByName(late.select("event_id", "batch", F.lit(True).alias("late")))


@query("select event_id, user_id, event_type from events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    twice = _stream(spark, d)
    return E.drain(E.deduplicated(twice.union(twice)).select("event_id", "user_id", "event_type"), "append")


@query("select strftime(ts, '%Y-%m-%d %H:%M:%S') ts, event_type, props query from events")
def event_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Events sent as messages by a stream and decoded again."""
    path = shared_path(spark)
    sent = _stream(spark, d).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "event_type", F.col("props").alias("query"))
    E.to_files(sent, path, f"{path}-state").awaitTermination()
    return E.decode(spark.read.text(path)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("select count(*) events, count(distinct user_id) users, (select count(*) from embeddings) vectors, (select count(*) from part) items from events")
def stats(spark: SparkSession, d: str) -> DataFrame:
    one = T.read(spark, d, "events").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return one.crossJoin(T.read(spark, d, "embeddings").agg(F.count("*").alias("vectors"))).crossJoin(T.read(spark, d, "part").agg(F.count("*").alias("items")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ten unseen items for every user by exact similarity to the mean of what they used."""
    return recommend_topk(spark, d)


