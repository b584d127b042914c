"""Records about people derived from the benchmark tables, by expressions that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ["alexander", "andrew", "william", "robert", "christopher", "daniel", "david", "james", "jonathan", "katherine", "elizabeth", "matthew", "michael", "nicholas", "samuel", "steven", "thomas", "anthony", "peter", "laura"]
SHORT = ["alex", "andy", "bill", "bob", "chris", "dan", "dave", "jim", "jon", "kate", "liz", "matt", "mike", "nick", "sam", "steve", "tom", "tony", "peter", "laura"]
SURNAMES = ["adams", "baker", "clark", "davis", "evans", "foster", "grant", "hayes", "irwin", "jones", "keller", "lewis", "mason", "nolan", "owens", "parker", "quinn", "reed", "stone", "turner", "usher", "vance", "walker", "young", "zimmer"]
COUNTRY = ["US", "GB", "IN", "CA", "AU", "DE", "FR", "SG"]
SKILL = ["Python", "SQL", "Gen Ai", "Generative Ai", "Machine Learning", "Structured Query Language", "PyTorch", "Data Science"]


def view_sql(dialect: str, table: str = "{}") -> str:
    """The records as one SELECT: a row per customer, supplier, order and turn of a conversation.

    ``dialect`` is ``spark`` or ``duckdb``, ``table`` a template of table names.
    """
    spark = dialect == "spark"

    def item(values: list[str], i: str) -> str:
        quoted = ", ".join(f"'{v}'" for v in values)
        return f"element_at(array({quoted}), CAST({i} AS INT) + 1)" if spark else f"list_extract([{quoted}], CAST({i} AS INT) + 1)"

    def div(a: str, b: int) -> str:
        return f"({a} DIV {b})" if spark else f"({a} // {b})"

    def title(x: str) -> str:
        return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"

    def array(*xs: str) -> str:
        return f"array({', '.join(xs)})" if spark else f"[{', '.join(xs)}]"

    first, nick, last = item(GIVEN, "p % 20"), item(SHORT, "p % 20"), item(SURNAMES, f"{div('p', 20)} % 25")
    a, b, c = item(SKILL, "p % 8"), item(SKILL, f"{div('p', 8)} % 8"), item(SKILL, "(p + 3) % 8")
    two = f"CASE WHEN p % 8 = {div('p', 8)} % 8 THEN {array(a)} ELSE {array(a, b)} END"
    text = "STRING" if spark else "VARCHAR"
    phone = f"CASE WHEN p % 4 <> 0 THEN '+1' || CAST(2000000000 + p AS {text}) END"
    null = f"CAST(NULL AS {text})"
    num = "DOUBLE"

    def part(rank: int, kind: str, priority: int, source: str, key: str, p: str, name: str, email: str, phone_: str, country: str, skills: str, years: str) -> str:
        inner = f"SELECT {key} AS k, {p} AS p, * FROM {table.format(source)}"
        return f"SELECT {rank} AS rank, k, '{kind}' AS source_type, '{kind}:' || CAST(k AS {text}) AS source_tag, {priority} AS priority, {name} AS full_name, {email} AS email, {phone_} AS phone, {country} AS country, {skills} AS skills, CAST({years} AS {num}) AS experience_yrs FROM ({inner})" + ("" if spark else " AS t")

    parts = [
        part(0, "CSV", 80, "customer", "c_custkey", "c_custkey", f"{title(first)} || ' ' || {title(last)}", f"CASE WHEN p % 3 <> 0 THEN lower({first} || '.' || {last} || CAST(p AS {text}) || '+' || c_mktsegment || '@gmail.com') END", phone, item(COUNTRY, "c_nationkey % 8"), two, "p % 20"),
        part(1, "ATS", 100, "supplier", "s_suppkey", "s_suppkey * 7", f"{title(nick)} || ' ' || {title(last)}", f"{first} || {last} || CAST(p AS {text}) || '@googlemail.com'", null, item(COUNTRY, "s_nationkey % 8"), array(a), "p % 20 + 1"),
        part(2, "Resume", 60, "orders", "o_orderkey", "o_custkey", f"{title(first)} || ' Q. ' || {title(last)}", null, phone, null, f"CASE WHEN p % 8 = {div('p', 8)} % 8 THEN {array(a, c)} WHEN (p + 3) % 8 = {div('p', 8)} % 8 THEN {array(a, b)} ELSE {array(a, b, c)} END", "NULL"),
        part(3, "Notes", 40, "conversations", "conv_id * 100000 + turn", "conv_id * 5", f"{title(nick)} || ' ' || {title(last)}", null, null, item(COUNTRY, "p % 8"), two, "NULL"),
    ]
    union = " UNION ALL ".join(parts)
    return f"SELECT CAST(rank AS BIGINT) * 1000000000000 + k AS seq, source_type, source_tag, priority, full_name, email, phone, country, skills, experience_yrs FROM ({union})" + ("" if spark else " AS u")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a DataFrame of the record schema's columns."""
    for name in ("customer", "supplier", "orders", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"confluo_{name}")
    df = spark.sql(view_sql("spark", "confluo_{}"))
    return df.withColumn("aliases", F.array().cast("array<string>")).withColumn("date_of_birth", F.lit(None).cast("string")).withColumn("source_id", F.substring_index("source_tag", ":", -1))
