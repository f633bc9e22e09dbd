"""Queries of this subpackage by name, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import blank_to_null, py_strip
from ..session import table
from . import canonical, encode, encoding, language, packing, records, residue, sentences

#: Tokens that a container of p9 holds.
CAPACITY = 2048


def _damage_model(works: DataFrame) -> encoding.Model:
    words = works.select(F.explode(encoding.strange_words("abstract_inverted_index")).alias("text"))
    return encoding.learn(works.select(F.col("title").alias("text")).unionAll(words))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged rows and fields with their non-ASCII texts as far as they can be restored."""
    works = table(spark, sf_dir, "works").select("row_no", "title", "abstract_inverted_index")
    fields = {"title": encoding.strange_text("title"), "abstract_inverted_index": encoding.strange_words("abstract_inverted_index")}
    model = _damage_model(works)
    found = encoding.find_damage(works, "row_no", fields, model)
    return found.unionAll(encoding.find_lossy(works, "row_no", fields, model, {"abstract_inverted_index": encoding.whole_index("abstract_inverted_index")}))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select("row_no", "field_name").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.score(table(spark, sf_dir, "processed_s2"), "oa_id", "summary").filter("score > 0").select("oa_id")


def _title_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    works = table(spark, sf_dir, "works")
    damage = _damage_model(works)
    shared = spark.sparkContext.broadcast(damage.args())

    def mend():
        model = encoding.Model(*shared.value)
        return lambda t: model.repair(t)[1]

    rows = works.select("row_no", "title", "language")
    return rows, language.judge_texts(rows, "title", language.train(rows, "title", "language"), mend)


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every title's parts."""
    rows, parts = _title_parts(spark, sf_dir)
    return rows.join(parts, rows["title"] == parts["text"]).select("row_no", F.posexplode("parts").alias("part", "p")).select("row_no", "part", "p.start", "p.end", "p.lang", "p.confidence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts = _title_parts(spark, sf_dir)
    judged = rows.join(parts, rows["title"] == parts["text"])
    each = judged.select("row_no", language.label_code("language").alias("said"), F.size("parts").alias("n"), F.explode(F.array_distinct("parts.lang")).alias("lang"))
    return each.filter((F.col("n") > 1) | ~F.col("said").eqNullSafe(F.col("lang"))).select("row_no", "lang")


#: Fields of a paper that are chosen one by one.
FIELDS = ["abstract_inverted_index", "doi", "language", "publication_date", "title", "venue"]


def _paper_groups(works: DataFrame) -> DataFrame:
    return records.link_groups(works, "row_no", [blank_to_null("id"), records.doi_key("doi")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "works").select("row_no", "id", "updated_date", *FIELDS)
    return records.current_rows(works, _paper_groups(works), "row_no", "updated_date", FIELDS)


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group, undated rows ordered by learned value transitions."""
    works = table(spark, sf_dir, "works").select("row_no", "id", "updated_date", *FIELDS)
    supply = records.current_rows(works, _paper_groups(works), "row_no", "updated_date", FIELDS, undated="currency")
    return records.build_records(works, supply, "row_no", FIELDS).withColumn("abstract_inverted_index", F.to_json("abstract_inverted_index"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = table(spark, sf_dir, "species_ref")
    said = table(spark, sf_dir, "final_relevant").select("rec_no", F.posexplode("species").alias("pos", "value")).filter(py_strip("value") != "")
    said = said.join(ref.select(F.col("common_name").alias("value")), "value", "left_anti")
    found = canonical.map_values(said, "value", ref, "species_id", ["common_name", "scientific_name"], ["other_names"])
    return said.join(found, "value").select("rec_no", "pos", F.coalesce("ref", F.lit(0).cast("bigint")).alias("species_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(encode.token_counts(table(spark, sf_dir, "documents")), CAPACITY)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p3_found": p3_found, "p3_segments": p3_segments, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found}


_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


P4_SQL = f"""
    WITH RECURSIVE k AS (
        SELECT row_no, nullif({_strip('id')}, '') AS i,
               nullif({_strip("regexp_replace(lower(" + _strip('doi') + "), '^(https?://[^/]+/|doi:)', '')")}, '') AS d
        FROM works),
    pairs AS (SELECT DISTINCT a.row_no AS x, b.row_no AS y FROM k a JOIN k b ON a.i = b.i
              UNION SELECT a.row_no, b.row_no FROM k a JOIN k b ON a.d = b.d),
    reach(x, y) AS (SELECT row_no, row_no FROM works UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
    g AS (SELECT x AS row_no, min(y) AS group_row FROM reach GROUP BY x HAVING count(*) > 1),
    f AS (
        SELECT group_row, unnest(['abstract_inverted_index', 'doi', 'language', 'publication_date', 'title', 'venue']) AS field_name,
               unnest([coalesce(cardinality(abstract_inverted_index), 0) > 0] || list_transform([doi, language, publication_date, title, venue], lambda v: coalesce({_strip('v')}, '') <> '')) AS ok,
               coalesce(updated_date, '') AS v, row_no
        FROM works JOIN g USING (row_no))
    SELECT group_row, field_name, arg_max(row_no, (v, row_no)) AS row_no FROM f WHERE ok GROUP BY group_row, field_name"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL}
