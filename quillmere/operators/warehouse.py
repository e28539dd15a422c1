"""The layered warehouse: raw rows, cleaned rows, users with their posts, and two marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.plans.registry import query

#: Ages are as of this day, never of today.
AS_OF = "2018-06-01"
PROFILE = ("activities", "about", "music")

# Role: the social database, made of customers and their orders.
_RAW_USERS = """
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE CAST(c_custkey % 3 AS INTEGER) END AS sex,
       CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN concat(CAST(1 + c_custkey % 28 AS VARCHAR(9)), '.', CAST(1 + c_custkey % 12 AS VARCHAR(9)))
            WHEN c_custkey % 50 = 3 THEN '31.2.1990' WHEN c_custkey % 50 = 4 THEN '29.2.1985'
            ELSE concat(CAST(1 + c_custkey % 28 AS VARCHAR(9)), '.', CAST(1 + c_custkey % 12 AS VARCHAR(9)), '.', CAST(1950 + c_custkey % 60 AS VARCHAR(9))) END AS bdate,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS activities,
       CASE WHEN c_custkey % 3 > 0 THEN '' ELSE c_name END AS about,
       CASE WHEN c_custkey % 8 > 0 THEN NULL ELSE 'music' END AS music
FROM customer"""
_RAW_POSTS = "SELECT o_custkey AS from_id, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS post FROM orders"


def _raw(t, sql: str, name: str) -> DataFrame:
    return t(name).sparkSession.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: t(name)})


def raw_users(t) -> DataFrame:
    return _raw(t, _RAW_USERS, "customer")


def raw_posts(t) -> DataFrame:
    return _raw(t, _RAW_POSTS, "orders")


def nullify(column: str) -> Column:
    """The empty string as null."""
    return F.nullif(F.col(column), F.lit(""))


def birth_day(text: Column) -> Column:
    """A date from d.M.yyyy; 29.2 counts as 28.2, and what is no date or lacks a year is null."""
    mended = F.regexp_replace(text, r"^29\.0?2\.", "28.2.")
    whole = F.when(mended.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), mended)
    return F.try_to_timestamp(whole, F.lit("d.M.yyyy")).cast("date")


def age(text: Column, as_of: str = AS_OF) -> Column:
    """Whole calendar years on the day."""
    day, born = F.lit(as_of).cast("date"), birth_day(text)
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(born) * 100 + F.dayofmonth(born))
    return (F.year(day) - F.year(born) - before.cast("int")).cast("int")


def clean_users(users: DataFrame) -> DataFrame:
    return users.select("id", age(F.col("bdate")).alias("age"), *(nullify(c).alias(c) for c in PROFILE), "sex")


def clean_posts(posts: DataFrame) -> DataFrame:
    return posts.select("from_id", nullify("post").alias("post"))


def users_with_posts(users: DataFrame, posts: DataFrame) -> DataFrame:
    """Users with the set of their posts, sorted and joined.

    Posts are aggregated before the join, so a user with many of them is one row in it. A user
    whose posts are all null gets the empty string, one without posts null.
    """
    texts = posts.groupBy(F.col("from_id").alias("id")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("post"))).alias("posts"))
    return users.join(texts, "id", "left").select("id", *PROFILE, "posts", "sex", "age")


_MENDED = "regexp_replace(bdate, '^29\\.0?2\\.', '28.2.')"
_BORN = f"CASE WHEN regexp_matches({_MENDED}, '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}$') THEN CAST(try_strptime({_MENDED}, '%d.%m.%Y') AS DATE) END"
_USERS_SQL = f"""SELECT id, CAST(2018 - year(born) - CASE WHEN 601 < month(born) * 100 + day(born) THEN 1 ELSE 0 END AS INTEGER) AS age,
       nullif(activities, '') AS activities, nullif(about, '') AS about, nullif(music, '') AS music, sex
FROM (SELECT *, {_BORN} AS born FROM ({_RAW_USERS}) r) u"""
_POSTS_SQL = f"SELECT from_id, nullif(post, '') AS post FROM ({_RAW_POSTS}) p"
_ADS_SQL = f"""SELECT u.id, activities, about, music, p.posts, sex, age FROM ({_USERS_SQL}) u
LEFT JOIN (SELECT from_id, coalesce(string_agg(DISTINCT post, ' ' ORDER BY post), '') AS posts FROM ({_POSTS_SQL}) q GROUP BY from_id) p ON p.from_id = u.id"""
_ANY = "coalesce(activities, about, music, posts) IS NOT NULL"


@query("F3 D1 P3 S7 V1 V2", _USERS_SQL)
def ods_users(t) -> DataFrame:
    return clean_users(raw_users(t))


@query("F3 P3", _POSTS_SQL)
def ods_posts(t) -> DataFrame:
    return clean_posts(raw_posts(t))


@query("A4 J4", _ADS_SQL)
def ads_users_with_posts(t) -> DataFrame:
    return users_with_posts(ods_users(t), ods_posts(t))


@query("P7", f"SELECT * FROM ({_ADS_SQL}) a WHERE sex IS NOT NULL AND sex <> 0 AND {_ANY}")
def dm_users_sex(t) -> DataFrame:
    known = F.coalesce(*(F.col(c) for c in (*PROFILE, "posts"))).isNotNull()
    return ads_users_with_posts(t).where(F.col("sex").isNotNull() & (F.col("sex") != 0) & known)


@query("P8", f"SELECT * FROM ({_ADS_SQL}) a WHERE age IS NOT NULL AND {_ANY}")
def dm_users_age(t) -> DataFrame:
    known = F.coalesce(*(F.col(c) for c in (*PROFILE, "posts"))).isNotNull()
    return ads_users_with_posts(t).where(F.col("age").isNotNull() & known)


@query("A5 S13", f"SELECT u.id, p.texts FROM ({_RAW_USERS}) u JOIN (SELECT from_id, string_agg(post, ',' ORDER BY post) AS texts FROM ({_RAW_POSTS}) q GROUP BY from_id) p ON p.from_id = u.id")
def user_group_concat(t) -> DataFrame:
    texts = raw_posts(t).groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list("post")).alias("a"))
    joined = F.when(F.size("a") > 0, F.array_join("a", ","))
    return raw_users(t).select("id").join(texts, "id").select("id", joined.alias("texts"))


def missing(users: DataFrame, start: int, stop: int) -> DataFrame:
    """The ids from start up to, without, stop that no row of users has."""
    return users.sparkSession.range(start, stop).join(users.select("id"), "id", "left_anti")


@query("S22 J12", "SELECT CAST(i AS BIGINT) AS id FROM (SELECT unnest(range(a, b + 1)) AS i FROM (SELECT min(c_custkey) AS a, max(c_custkey) AS b FROM customer) r) x WHERE i NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)")
def missing_ids(t) -> DataFrame:
    """Ids between the table's least and greatest that no stored user has."""
    customers = t("customer").select(F.col("c_custkey").alias("id"))
    first, last = customers.agg(F.min("id"), F.max("id")).first()
    users = customers.where("id % 9 <> 0")
    return users.limit(0) if first is None else missing(users, first, last + 1)


@query("S23 K10 J13", "SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS done FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unprocessed_users(t) -> DataFrame:
    """Users not yet processed, with the flag of those that a batch has just done: two probes."""
    users, orders = t("customer").select(F.col("c_custkey").alias("id")), t("orders")
    status = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")).distinct()
    left = users.join(status("P"), "id", "left_anti")
    return left.join(status("F").withColumn("done", F.lit(True)), "id", "left").select("id", F.coalesce("done", F.lit(False)).alias("done"))


@query("D2 D3", f"""SELECT id, CAST(2018 - year(born) - CASE WHEN 601 < month(born) * 100 + day(born) THEN 1 ELSE 0 END AS INTEGER) AS calendar,
       CAST(floor(date_diff('day', born, DATE '2018-06-01') / 365.25) AS INTEGER) AS floored, round(date_diff('day', born, DATE '2018-06-01') / 365.25, 4) AS exact
FROM (SELECT id, {_BORN} AS born FROM ({_RAW_USERS}) r) u""")
def age_three_ways(t) -> DataFrame:
    born = birth_day(F.col("bdate"))
    years = F.datediff(F.lit(AS_OF).cast("date"), born) / F.lit(365.25)
    return raw_users(t).select("id", age(F.col("bdate")).alias("calendar"), F.floor(years).cast("int").alias("floored"), F.round(years, 4).alias("exact"))


@query("V1 V2 V5 V7 V10", f"""SELECT sex, CAST(count(*) AS BIGINT) AS users, CAST(count(age) AS BIGINT) AS aged, CAST(min(age) AS INTEGER) AS youngest, CAST(max(age) AS INTEGER) AS oldest, CAST(sum(age) AS BIGINT) AS years, CAST(count(activities) AS BIGINT) AS active FROM ({_USERS_SQL}) u GROUP BY sex""")
def udf_surface(t) -> DataFrame:
    """The registered functions as column expressions, under a mergeable aggregate."""
    users = ods_users(t)
    return users.groupBy("sex").agg(
        F.count(F.lit(1)).alias("users"), F.count("age").alias("aged"), F.min("age").alias("youngest"), F.max("age").alias("oldest"),
        F.sum(F.col("age").cast("long")).alias("years"), F.count("activities").alias("active"),
    )


@query("Y8", f"SELECT id, CAST((CASE WHEN activities <> '' THEN 1 ELSE 0 END) + (CASE WHEN about <> '' THEN 1 ELSE 0 END) + (CASE WHEN music <> '' THEN 1 ELSE 0 END) AS INTEGER) AS filled FROM ({_RAW_USERS}) r")
def truthy_count(t) -> DataFrame:
    filled = sum((F.coalesce(F.col(c) != "", F.lit(False)).cast("int") for c in PROFILE), F.lit(0))
    return raw_users(t).select("id", filled.cast("int").alias("filled"))


@query("P9 P10", f"SELECT * FROM ({_USERS_SQL}) u WHERE (CASE WHEN age IS NULL THEN 0 ELSE 1 END) + (CASE WHEN activities IS NULL THEN 0 ELSE 1 END) + (CASE WHEN about IS NULL THEN 0 ELSE 1 END) + (CASE WHEN music IS NULL THEN 0 ELSE 1 END) + (CASE WHEN sex IS NULL THEN 0 ELSE 1 END) >= 3 AND age IS NOT NULL")
def threshold_non_null(t) -> DataFrame:
    users = ods_users(t)
    return users.dropna(thresh=3, subset=["age", *PROFILE, "sex"]).dropna(subset=["age"])


@query("R14 R15 M18", f"SELECT id, coalesce(activities, about, 'none') AS text, coalesce(CAST(age AS DOUBLE), round((SELECT avg(age) FROM ({_USERS_SQL}) a), 4)) AS age FROM ({_USERS_SQL}) u")
def fallback_coalesce(t) -> DataFrame:
    """Known values first, else a second source, else a prediction (here the mean)."""
    users = ods_users(t)
    mean = users.agg(F.round(F.avg("age"), 4).alias("mean"))  # one row
    text = F.coalesce("activities", "about", F.lit("none")).alias("text")
    return users.join(F.broadcast(mean)).select("id", text, F.coalesce(F.col("age").cast("double"), "mean").alias("age"))
