"""Registered queries of the sources, of text records, of the merge as a whole and of the sinks, each with its SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import identity, prose
from .operators import evaluate, merge
from .operators.project import Config, project
from .plans.engine import Engine, write_json_lines
from .plans.people import people
from .plans.scratch import Scratch
from .queries import _NICK, _OVERALL, _PARTS, _TITLED, _WIDE, PEOPLE, _pattern, _profiles, _quoted, _sql_detect, _sql_sorted, _table, query
from .sources import files
from .sources.pdf import pdf_text

# --- Files --------------------------------------------------------------------------------------------------------

def _write_csv(df: DataFrame, path: str) -> None:
    """A table in CSV files in the order of the rows, each with a header."""
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


_CSV_NAMES = {"full_name": "Candidate_Name", "email": "mail", "phone": "Cell", "country": "location", "skills": "Technologies", "experience_yrs": "experience"}


@query(
    f"WITH {PEOPLE}, csv AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM people WHERE source_type = 'CSV') "
    f"SELECT n - 1 AS seq, 'CSV:people.csv#row' || n AS source_tag, 80 AS priority, full_name, email, phone, country, {_sql_sorted('skills')} AS skills, experience_yrs FROM csv"
)
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' records, spelt loosely into a CSV file and parsed from it."""
    scratch = Scratch(spark)
    rows = people(spark, sf_dir).where("source_type = 'CSV'")
    loose = {
        "full_name": F.concat(F.lit("  Dr. "), F.upper("full_name"), F.lit(" ;")),
        "email": F.upper("email"),
        "phone": F.concat(F.lit("+1 ("), F.substring("phone", 3, 3), F.lit(") "), F.substring("phone", 6, 7)),
        "country": F.lower("country"),
        "skills": F.array_join("skills", " ; "),
        "experience_yrs": F.concat(F.lit('about "'), F.col("experience_yrs").cast("int").cast("string"), F.lit('", roughly')),
    }
    path = f"{scratch.path}/people.csv"
    _write_csv(rows.orderBy("seq").select(*[c.alias(_CSV_NAMES[k]) for k, c in loose.items()]), path)
    got = files.parse_csv(spark, path, 0, scratch)
    return got.select("seq", "source_tag", "priority", "full_name", "email", "phone", "country", F.array_join("skills", "|").alias("skills"), "experience_yrs")


@query(
    "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) "
    "SELECT n - 1 AS seq, 'orders.csv#row' || n AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN 'No Pri\"ority' WHEN o_orderkey % 3 = 1 THEN 'Pay, Later' END AS full_name, 'o' || o_orderkey || '@x.org' AS email, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Data Science|Python|SQL' ELSE 'PyTorch' END AS skills, (o_orderkey % 20)::DOUBLE AS experience_yrs FROM n"
)
def csv_line_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per order, with quotes, commas and line feeds inside quotes, from CSV files that are read in ranges."""
    scratch = Scratch(spark)
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").orderBy(k).select(
        F.when(k % 2 == 0, 'data science\n"python",\r\nsql\n').otherwise("\npytorch").alias("Skill"),
        F.when(k % 3 == 0, 'no pri"ority').when(k % 3 == 1, "pay,\nlater").alias(" NAME"),
        F.concat(F.lit("o"), k, F.lit("@X.org")).alias("mail"),
        F.concat(k % 20, F.lit(" years\n,")).alias("Experience"),
    )
    _write_csv(rows, path := f"{scratch.path}/orders.csv")
    got = files.parse_csv(spark, path, 0, scratch)
    return got.select("seq", "source_id", "full_name", "email", F.array_join("skills", "|").alias("skills"), "experience_yrs")


_JSON_FILES = 8


def _in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a file whose objects are items of a list within an object, an item that is none before each."""
    first = True
    for batch in batches:
        lines = [f"{'' if first and k == 0 else ','}17,{x}" for k, x in enumerate(batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_pydict({"value": (['{"other": {"data": [1]}, "profiles": ['] if first else []) + lines})
        first = False
    if not first:
        yield pa.RecordBatch.from_pydict({"value": ["]}"]})


def _write_json_lists(objects: DataFrame, path: str) -> None:
    """Objects (a column of text) in several files of ``_in_lists``, written in parallel."""
    objects.repartition(_JSON_FILES).mapInArrow(_in_lists, "value string").write.text(path)


def _write_json_list(scratch: Scratch, objects: DataFrame, path: str) -> None:
    """Objects (a column of text) in their order in one file of ``_in_lists``; what is sorted before by many tasks streams through the one that writes it."""
    objects.coalesce(1).mapInArrow(_in_lists, "value string").write.text(parts := f"{path}-parts")
    at, store = scratch.place(parts)
    for part in store.globStatus(scratch.place(f"{parts}/part-*")[0]):
        store.rename(part.getPath(), scratch.place(path)[0])


@query(
    f"WITH {PEOPLE}, ats AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM people WHERE source_type = 'ATS') "
    f"SELECT 2 * n - 1 AS seq, 'ATS:people.json#' || 2 * n AS source_tag, full_name, email, country, {_sql_sorted('skills')} AS skills, experience_yrs FROM ats"
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' records in their order as objects of a list in one JSON file, an item that is none before each, parsed from it in ranges."""
    scratch = Scratch(spark)
    rows = people(spark, sf_dir).where("source_type = 'ATS'").orderBy("seq")
    text = F.to_json(F.struct(F.lit("").alias("name"), F.upper("full_name").alias("Candidate"), F.col("email").alias("email_address"), F.struct("country").getField("country").alias("country_code"), F.col("skills").alias("skill_set"), F.col("experience_yrs").alias("years_experience")))

    path = f"{scratch.path}/people.json"
    _write_json_list(scratch, rows.select(text.alias("value")), path)
    got = files.parse_ats(spark, path, 0, scratch)
    return got.select("seq", "source_tag", "full_name", "email", "country", F.array_join("skills", "|").alias("skills"), "experience_yrs")


_TOWN = ["Germany", "India", "France", "Singapore", "Canada"]


_NOTE = "'Candidate goes by ' || r_name || '.' || chr(10) || 'Mail ' || replace(r_name, ' ', '') || '@EXAMPLE.org or (212) 555-010' || r_regionkey || chr(13) || chr(10) || 'DOB: March ' || (r_regionkey + 1) || ', 1980.' || chr(10) || 'Skills: sql / python' || chr(10) || 'Located in ' || {town} || chr(10) || (r_regionkey + 2) || '.5 years of experience' || chr(10)"


@query(
    f"SELECT r_regionkey::BIGINT + {3 * files.KIND_SPAN} AS seq, 'Notes' AS source_type, 'Notes:note' || r_regionkey || '.txt' AS source_tag, 40 AS priority, upper(r_name[1]) || lower(r_name[2:]) AS full_name, lower(replace(r_name, ' ', '')) || '@example.org' AS email, "
    f"'+1212555010' || r_regionkey AS phone, {_sql_detect(_NOTE.format(town=f'list_extract({_TOWN}, r_regionkey + 1)'))} AS country, 'Python|SQL' AS skills, '1980-03-0' || (r_regionkey + 1) AS date_of_birth, (r_regionkey + 2.5)::DOUBLE AS experience_yrs FROM region WHERE r_name NOT LIKE '% %'"
)
def note_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per region of one word, written as files and parsed in their order; a file that is missing and a blank one give nothing."""
    scratch = Scratch(spark)
    note = F.expr(_NOTE.format(town=f"element_at(array({_quoted(_TOWN)}), CAST(r_regionkey AS INT) + 1)"))
    regions = _table(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_name").contains(" "), F.lit(" \n\t")).otherwise(note).alias("note")).orderBy("r_regionkey").collect()  # five rows
    paths = [f"{scratch.path}/note{r.r_regionkey}.txt" for r in regions]
    for path, r in zip(paths, regions, strict=True):
        at, store = scratch.place(path)
        out = store.create(at)
        out.write(bytearray(r.note.encode()))
        out.close()
    got = files.parse_many(spark, [*paths, f"{scratch.path}/none.txt"], "notes", 3 * files.KIND_SPAN, scratch)
    return got.select("seq", "source_type", "source_tag", "priority", "full_name", "email", "phone", "country", F.array_join("skills", "|").alias("skills"), "date_of_birth", "experience_yrs")


#: A folder per row: each task moves its own to their place, instead of the driver all, one after the other.
_MOVED_BY_TASKS = ("mapreduce.fileoutputcommitter.algorithm.version", "2")

_TURN = "'Mail c' || conv_id || 't' || turn || '@EXAMPLE.org' || chr(10) || 'Skills: sql' || chr(10) || text"


@query(f"SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, 'c' || conv_id || 't' || turn || '@example.org' AS email, {_sql_detect(_TURN)} AS country FROM conversations")
def note_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of the conversations as a file of its own, all below one folder, read by one scan in the order of their paths."""
    scratch = Scratch(spark)
    name = F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 9, "0"))
    path = f"{scratch.path}/turns"
    _table(spark, sf_dir, "conversations").select(name.alias("at"), F.expr(_TURN).alias("value")).write.partitionBy("at").option(*_MOVED_BY_TASKS).text(path)
    got = files.parse_many(spark, path, "notes", 3 * files.KIND_SPAN, scratch)
    return got.select((F.col("seq") - 3 * files.KIND_SPAN).alias("place"), "email", "country")


_SHEET = "c_name || ' (no. ' || c_custkey || ')' || chr(10) || 'Mail c' || c_custkey || '@X.org' || chr(10) || 'Skills: sql, python'"


def _pdf(text: str) -> bytes:
    """A file of one page that shows the lines of a text, compressed."""
    escaped = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252")
    content = zlib.compress(b"BT /F1 11 Tf 14 TL 50 700 Td (" + escaped.replace(b"\n", b") Tj T* (") + b") Tj ET")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(content), content)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, x) for k, x in enumerate(objects, 1)) + b"%%EOF\n"


@F.arrow_udf(T.BinaryType())
def _pdfs(text: pa.Array) -> pa.Array:
    return pa.array([_pdf(x.as_py()) for x in text], pa.binary())


@query(f"SELECT c_custkey, {_SHEET} AS text, 'c' || c_custkey || '@x.org' AS email, 'Python|SQL' AS skills FROM customer")
def pdf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF file per customer, and what is read from it."""
    text = pdf_text(_pdfs(F.expr(_SHEET)))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    fields = files.text_fields(F.col("text"), "Resume")
    return rows.select("c_custkey", "text", fields["email"].alias("email"), F.array_join(fields["skills"], "|").alias("skills"))


_UNIQUE = "'K' || translate(CAST(c_custkey AS {text}), '0123456789', 'abcdefghij') || ' Winter'"


@query(
    f"SELECT {_UNIQUE.format(text='VARCHAR')} AS full_name, 'c' || c_custkey || '@x.org' AS email, '+1' || CASE WHEN c_custkey % 3 = 0 THEN 2100000000 + c_custkey ELSE 2000000000 + c_custkey END AS phone, CASE WHEN c_custkey % 3 = 0 THEN 'DE' ELSE 'FR' END AS country, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'SQL' END AS skills, (c_custkey % 20 + (c_custkey % 3 = 0)::INT)::DOUBLE AS experience_yrs, CASE WHEN c_custkey % 3 = 0 THEN 0.9 ELSE 0.82 END::DOUBLE AS email_confidence, CASE WHEN c_custkey % 3 = 0 THEN 0.41 ELSE 0.85 END::DOUBLE AS weighted FROM customer"
)
def engine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to projected profiles: a CSV row per customer, for each third of them a JSON object of the same address, with the usual trust and another one."""
    scratch = Scratch(spark)
    k, rows = F.col("c_custkey"), _table(spark, sf_dir, "customer")
    table = rows.select(F.expr(_UNIQUE.format(text="STRING")).alias("Name"), F.concat(F.lit("c"), k, F.lit("@x.org")).alias("Mail"), F.concat(F.lit("+1"), k + 2000000000).alias("Cell"), F.lit("France").alias("Location"), (k % 20).alias("Experience"))
    _write_csv(table, f"{scratch.path}/table.csv")
    other = F.struct(F.concat(F.lit("C"), k, F.lit("@X.ORG")).alias("mail"), F.concat(F.lit("+1"), k + 2100000000).alias("cell"), F.lit("Germany").alias("location"), F.array(F.lit("sql")).alias("skills"), (k % 20 + 1).alias("experience"))
    _write_json_lists(rows.where(k % 3 == 0).select(F.to_json(other).alias("value")), f"{scratch.path}/objects")
    fields = ["full_name", "email", "phone", "country", "skills", "experience_yrs"]
    config = {"fields": [{"path": f} for f in fields], "include_confidence": True}
    paths = {"csv": [f"{scratch.path}/table.csv"], "ats": [f"{scratch.path}/objects", f"{scratch.path}/none.json"]}
    usual = Engine(spark).run(config, **paths)
    # countries: of the list, which the table contradicts, 0.85 * (0.6 + 0.4 * 0) - 0.2 / 2; of the table alone 0.85 * (0.6 + 0.4 * 1)
    weighted = Engine(spark, trust_weights={"CSV": 1.0, "ATS": 0.0}).run(config, **paths).select("email", F.col("country_confidence").alias("weighted"))
    return usual.select(*[F.array_join(f, "|").alias(f) if f == "skills" else f for f in fields], "email_confidence").join(weighted, "email")


@query("SELECT event_id, nullif(json_extract_string(props, '$.k'), '') AS picked FROM events")
def pick_alias_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty value under the first alias, the wanted one under a later alias in another spelling."""
    text = F.replace("props", F.lit('"k"'), F.lit('"phone": "", " CELL "'))
    entries = F.map_entries(F.variant_get(F.try_parse_json(text), "$", "map<string,variant>"))
    return _table(spark, sf_dir, "events").select("event_id", F.try_variant_get(files._entry(entries, "phone"), "$", "string").alias("picked"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN ' ' ELSE nullif(n_regionkey::VARCHAR, '') END AS picked FROM nation")
def pick_alias_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alias with a value; white space counts as one, an empty text does not."""
    k = F.col("n_nationkey") % 3
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.when(k == 0, F.col("n_name")).when(k == 1, " ").otherwise("").alias(" Country "), F.col("n_regionkey").cast("string").alias("LOCATION"))
    columns = {c.strip().lower(): c for c in rows.columns}
    return rows.select("n_nationkey", files.pick(columns, "country").alias("picked"))


# --- Text ---------------------------------------------------------------------------------------------------------

_CLEAN = f"trim(regexp_replace(line, '{_pattern(prose.LIST_MARK)}', ''))"
_LOW = f"regexp_replace(lower({_CLEAN}), '{_pattern(prose.AROUND_LABEL)}', '', 'g')"
_COUNT = f"len(regexp_extract_all({_CLEAN}, '{_pattern(prose.WORD)}'))"
_NO_NAME = (
    f"({_LOW} IN ({_quoted(prose.HEADINGS)}) OR regexp_matches({_LOW}, '{prose.KEYWORDS}') OR contains({_CLEAN}, ':') OR {_COUNT} > 5 OR ({_COUNT} = 2 AND {_LOW} IN ({_quoted(prose.JOB_TITLES)})) "
    f"OR regexp_matches({_LOW}, '{'|'.join(prose.PHRASES)}') OR (ends_with({_CLEAN}, '.') AND NOT regexp_matches({_CLEAN}, '{_pattern(prose.TITLED)}', 'i')))"
)


def _sql_name(x: str) -> str:
    bare = f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^[ \\t\\r\\n,;]+|[ \\t\\r\\n,;]+$', '', 'g'), '{_pattern(identity.SALUTATION)}', '', 'i'))"
    return f"list_transform([{bare}], lambda n: CASE WHEN n <> '' AND NOT regexp_matches(n, '[\\p{{Nd}}@]') THEN {_TITLED.format(x='n')} END)[1]"


_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_LABEL = f"regexp_extract(line, '{_pattern(prose.NAME_LABEL)}', 1, 'i')"
_NAME_TEXT = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('Resume', chr(10), '* dr. mary-ann  o''neil', chr(10), text) WHEN 1 THEN concat('Software Engineer', chr(10), 'Full Name - jo  smith', chr(10), text) ELSE text END"


@query(
    f"WITH cut AS (SELECT doc_id, regexp_split_to_array({_NAME_TEXT}, '{_BREAKS}') AS l FROM documents), "
    "placed AS (SELECT doc_id, trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS line, unnest(range(len(l))) AS pos FROM cut), "
    f"judged AS (SELECT doc_id, pos, regexp_matches(line, '{_pattern(prose.NAME_LABEL)}', 'i') AS labelled, {_sql_name(_LABEL)} AS named, {_sql_name(_CLEAN)} AS plain, {_NO_NAME} AS none FROM placed WHERE line <> ''), "
    f"fitting AS (SELECT *, CASE WHEN NOT none AND len(regexp_extract_all(plain, '{_pattern(prose.WORD)}')) BETWEEN 2 AND 5 THEN plain END AS other FROM judged), "
    "firsts AS (SELECT doc_id, min(pos) FILTER (labelled) AS p, min(pos) FILTER (other IS NOT NULL) AS q FROM fitting GROUP BY doc_id) "
    "SELECT d.doc_id, CASE WHEN p IS NOT NULL THEN a.named ELSE b.other END AS name FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id LEFT JOIN fitting a ON a.doc_id = d.doc_id AND a.pos = p LEFT JOIN fitting b ON b.doc_id = d.doc_id AND b.pos = q"
)
def name_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled name, else the first line like a name, in each document. What stands before a text that is null counts, as in the SQL, whose ``concat`` passes over nulls."""
    text = F.expr(_NAME_TEXT.replace("concat(", "concat_ws('', "))
    return _table(spark, sf_dir, "documents").select("doc_id", prose.extract_name(text, F.lit("Resume")).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in four spellings, and text without one."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "MMMM d, yyyy")).when(k == 2, F.date_format(day, "d MMM yyyy")).when(k == 3, F.concat(F.lit("on "), F.date_format(day, "yyyy/MM/dd"))).otherwise("no day")
    return _table(spark, sf_dir, "orders").select("o_orderkey", prose.normalize_date(text).alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN strftime(DATE '1950-01-01' + (c_custkey % 15000)::INT, '%Y-%m-%d') END AS born FROM customer")
def birth_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 15000).cast("int")), F.col("c_custkey") % 3
    text = F.concat(F.col("c_name"), F.lit("\n"), F.when(k == 0, F.concat(F.lit("Date of Birth: "), F.date_format(day, "d MMMM yyyy"))).when(k == 1, F.concat(F.lit("dob - "), F.date_format(day, "yyyy-MM-dd"))).otherwise("born"), F.lit("\nSkills: SQL"))
    return _table(spark, sf_dir, "customer").select("c_custkey", prose.extract_birth_date(text).alias("born"))


_MIXED = "p_name || '''S o-' || p_type || '2x'"


@query(f"SELECT p_partkey, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(s[i - 1], '[A-Za-z]') THEN upper(s[i]) ELSE lower(s[i]) END), '') AS title FROM (SELECT p_partkey, {_MIXED} AS s FROM part)")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", identity.str_title(F.expr(_MIXED.replace("'''S", "'\\'S"))).alias("title"))


# --- Matching and merging -----------------------------------------------------------------------------------------


def _sql_formal(side: str) -> str:
    return f"coalesce({_NICK}[{side}[1]], {side}[1])"


@query(
    f"WITH {PEOPLE}, cut AS (SELECT seq, {_PARTS} AS p FROM people), n AS (SELECT l.seq, step, l.p, r.p AS q FROM cut l, unnest([1, 20, 500]) AS s(step), cut r WHERE r.seq = l.seq + step) "
    f"SELECT seq, step, {_sql_formal('p')} = {_sql_formal('q')} OR (least(length({_sql_formal('p')}), length({_sql_formal('q')})) >= 3 AND (starts_with({_sql_formal('p')}, {_sql_formal('q')}) OR starts_with({_sql_formal('q')}, {_sql_formal('p')}))) AS first, p[-1][1] = q[-1][1] AS last FROM n"
)
def compatible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's name against those of records 1, 20 and 500 further on in its source."""
    rows = people(spark, sf_dir).select("seq", identity.name_parts(F.col("full_name")).alias("p"))
    left = rows.withColumn("step", F.explode(F.array(*[F.lit(k) for k in (1, 20, 500)])))
    right = rows.select(F.col("seq").alias("to"), F.col("p").alias("q"))
    both = left.join(right, F.col("seq") + F.col("step") == F.col("to"))
    first = identity.first_names_compatible(F.get("p", F.lit(0)), F.get("q", F.lit(0)))
    return both.select("seq", "step", first.alias("first"), identity.last_names_compatible(F.try_element_at("p", F.lit(-1)), F.try_element_at("q", F.lit(-1))).alias("last"))


@query(
    f"WITH {_OVERALL}, flat AS (SELECT cluster_id, {', '.join(f'max(selected) FILTER (field = {chr(39)}{f}{chr(39)}) AS {f}' for f in ('full_name', 'email', 'phone', 'country'))}, max(selected_num) AS experience_yrs FROM won GROUP BY cluster_id), sized AS (SELECT cluster_id, count(*) AS n_records FROM clustered GROUP BY cluster_id), "
    "whole AS (SELECT * FROM sized LEFT JOIN flat USING (cluster_id) LEFT JOIN (SELECT cluster_id, skills FROM skilled) USING (cluster_id) LEFT JOIN overall USING (cluster_id)) "
    "SELECT row_number() OVER (ORDER BY coalesce(email, ''), coalesce(full_name, ''), coalesce(phone, ''), cluster_id) - 1 AS position, cluster_id, n_records, full_name, email, phone, country, coalesce(skills, '') AS skills, experience_yrs, overall_confidence, overall_confidence < 0.75 AS needs_review FROM whole"
)
def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole profiles of the exact links' clusters, with their places in the output order."""
    scratch = Scratch(spark)
    columns = ["cluster_id", "n_records", *merge.FIELDS, "overall_confidence", "needs_review"]
    found = merge.positions(_profiles(spark, sf_dir, lambda df: df.select(*columns)), scratch)
    return found.select("position", "cluster_id", "n_records", "full_name", "email", "phone", "country", F.array_join("skills", "|").alias("skills"), "experience_yrs", "overall_confidence", "needs_review")


@query("SELECT doc_id, (coalesce(CASE WHEN quality = 1 THEN 0.9 END, 0.7)::DOUBLE + coalesce(CASE WHEN toxic = 0 THEN 0.5 END, 0.7)::DOUBLE) / 2 AS score FROM labels")
def card_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", evaluate.card_score(F.when(F.col("quality") == 1, 0.9), F.when(F.col("toxic") == 0, 0.5)).alias("score"))


# --- Sinks --------------------------------------------------------------------------------------------------------


@query(f"WITH {_WIDE} SELECT full_name AS name, lower(email) AS email, c_email AS email_confidence, country FROM wide")
def json_lines_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected profiles, missing values omitted, written as JSON lines and read back."""
    scratch = Scratch(spark)
    config = Config({"fields": [{"path": "full_name", "rename": "name", "required": True}, {"path": "email"}, {"path": "country", "normalize": "alpha2"}], "normalization": {"email": {"case": "lower"}}, "include_confidence": True, "on_missing": "omit"})
    write_json_lines(project(_profiles(spark, sf_dir), config), f"{scratch.path}/lines", omit_null=True)
    return spark.read.schema("name string, email string, email_confidence double, country string").json(f"{scratch.path}/lines")
