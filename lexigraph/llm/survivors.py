"""Best representative of each duplicate group, field by field (problem 3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import maybe_broadcast
from ..scratch import Scratch

# A parameter: words that fill a field without saying anything, in lower case.
FILLER = (
    "n/a", "na", "nil", "null", "none", "nan", "unknown", "tbd", "todo", "to do", "missing", "not available", "no description", "untitled",
    "inconnu", "inconnue", "néant", "neant", "aucun", "aucune", "vide", "non précisé", "non précisée", "non renseigné", "non renseignée",
    "à compléter", "a completer", "à définir", "à préciser", "indisponible", "description indisponible", "sans description", "sans objet",
    "غير معروف", "غير محدد", "لا يوجد",
)
#: Length of a record's vote: it halves each so many days before the group's newest record.
HALF_LIFE_DAYS = 180.0


#: White space of any kind, and with it the signs that close a statement: what is cut off at either end.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SIGNS = SPACES + ".!?…,:;"


def _said(text: Column) -> Column:
    """Whether a text in lower case says anything: it has a letter or digit and is not one of FILLER."""
    return text.rlike(r"[\p{L}\p{N}]") & ~F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(SIGNS)).isin(*FILLER)


def statements(text: Column) -> Column:
    """The different things a description states: its sentences, lines and parts between bars, without filler."""
    parts = F.split(F.lower(text), r"(?U)[|\n\r]+|(?<=[\p{L}\p{N})»\"]{2}[.!?…])\s+")
    bare = F.transform(parts, lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(SIGNS)))
    return F.array_distinct(F.filter(bare, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.isin(*FILLER)))


def different_aliases(aliases: Column) -> Column:
    clean = F.filter(F.transform(aliases, lambda x: F.btrim(F.lower(x), F.lit(SPACES))), lambda x: x.isNotNull() & _said(x))
    return F.array_sort(F.array_distinct(clean))


@dataclass(frozen=True)
class Field:
    """value: as text, for output. normal: what counts as the same value. quality: higher is better; the votes decide among
    values of one quality. normal and quality are SQL over columns that ``prepare`` adds."""

    name: str
    value: Column
    normal: Column
    quality: Column


def prepare(records: DataFrame) -> DataFrame:
    """Adds what the fields' normal values and qualities are taken from, each computed once."""
    return records.withColumns({"_aliases": different_aliases(F.col("aliases")), "_told": F.array_sort(statements(F.col("context_description"))), "_sure": F.when(F.col("confidence").between(0, 1), F.col("confidence"))})


def record_fields() -> list[Field]:
    """The fields of prepared records."""
    return [
        Field("aliases", F.to_json("aliases"), F.array_join("_aliases", "\n"), F.coalesce(F.size("_aliases"), F.lit(0)).cast("double")),
        Field("confidence", F.col("confidence").cast("string"), F.col("_sure").cast("string"), F.coalesce("_sure", F.lit(-1.0))),
        Field("context_description", F.col("context_description"), F.array_join("_told", "\n"), F.greatest(F.size("_told"), F.lit(0)).cast("double")),
    ]


def long_votes(records: DataFrame, key: str, rec_id: str, source: str, updated: str, fields: list[Field], half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """One row a record and field: (key, field, normal, quality, rec_id, at, vote), re-delivered records once.

    normal is a hash of the normalised value, so what is shuffled does not grow with the texts. vote = trust of the source, the
    share of its records' values that say anything, times a decay that halves each half-life. Trust is one aggregate over all
    records; null sources are one source. The unpivoted rows are written once: they are read for the trust and for the votes.
    """
    rows = prepare(records.filter(F.col(key).isNotNull() & F.col(rec_id).isNotNull())).select(
        F.col(key).alias("key"), F.col(rec_id).alias("rec_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(updated).alias("at"),
        *[c for f in fields for c in (F.xxhash64(f.normal).alias(f"n_{f.name}"), f.quality.alias(f"q_{f.name}"))],
    ).dropDuplicates(["key", "rec_id"])
    rows = Scratch(records.sparkSession, "survivors").keep(rows, "records")
    each = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"n_{f.name}").alias("normal"), F.col(f"q_{f.name}").alias("quality")) for f in fields])
    long = rows.select("key", "rec_id", "source", "at", F.explode(each).alias("f")).select("key", "rec_id", "source", "at", "f.*")
    trust = long.groupBy("source").agg(F.avg(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("trust"))
    days = F.coalesce(F.col("at"), F.lit("1970-01-01").cast("timestamp_ntz").cast(records.schema[updated].dataType)).cast("timestamp").cast("double") / 86400 - 20000
    return long.join(maybe_broadcast(trust), "source").withColumn("vote", F.col("trust") * F.pow(F.lit(2.0), days / half_life_days))


def best_values(votes: DataFrame) -> DataFrame:
    """(key, field, rec_id, quality, votes, records): the record with the winning value of each key and field.

    The votes of records with the same normalised value are added. The winner is the value of the highest quality, then of most
    votes, then the latest, then of the smallest rec_id; its rec_id is the latest record that has it. A key whose records
    hold no usable value gets its latest record. Both steps combine before the shuffle, so a key with a third of all rows
    sends one row a task and value.
    """
    newest = F.struct(F.col("at"), -F.col("rec_id"))
    per_value = votes.groupBy("key", "field", "quality", "normal").agg(
        F.round(F.sum("vote"), 9).alias("votes"), F.max_by("rec_id", newest).alias("rec_id"), F.max(newest).alias("newest"), F.count("*").alias("records")
    )
    won = per_value.groupBy("key", "field").agg(F.max_by(F.struct("rec_id", "quality", "votes"), F.struct("quality", "votes", "newest")).alias("w"), F.sum("records").alias("records"))
    return won.select("key", "field", "w.*", "records")


def survivors(records: DataFrame) -> DataFrame:
    """One row a normalized_name with the winning value of each field, pivoted back.

    Null names belong to no group. An empty table gives no rows; extra columns are ignored.
    """
    won = best_values(long_votes(records, "normalized_name", "rec_id", "model", "updated_at", record_fields())).select("key", "field", "rec_id")
    given = records.select(F.col("normalized_name").alias("key"), "rec_id", "aliases", "confidence", "context_description").dropDuplicates(["key", "rec_id"])
    of = lambda f: F.first(F.when(F.col("field") == f, F.col(f)), ignorenulls=True).alias(f)
    return won.join(given, ["key", "rec_id"]).groupBy(F.col("key").alias("normalized_name")).agg(of("aliases"), of("confidence"), of("context_description"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/graph_extraction_clean.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = long_votes(_clean(spark, sf_dir), "normalized_name", "rec_id", "model", "updated_at", record_fields())
    return best_values(votes).filter("records > 1").select(F.col("key").alias("normalized_name"), "field", "rec_id")


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = survivors(_clean(spark, sf_dir))
    return won.select("normalized_name", F.array_join(different_aliases(F.col("aliases")), "; ").alias("aliases"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "context_description")


QUERIES = {"p3_found": p3_found, "p3_survivors": p3_survivors}

_BARE = r"lower(regexp_replace(regexp_replace({x}, '[\s\x{{a0}}]+', ' ', 'g'), '^[\s.!?…,:;]+|[\s.!?…,:;]+$', '', 'g'))"
_FILLER = "({x} IS NULL OR NOT regexp_matches({x}, '[\\p{{L}}\\p{{N}}]') OR " + _BARE + " IN (" + ", ".join(f"'{w}'" for w in FILLER) + "))"
_ALIASES = f"list_sort(list_distinct([lower(trim(x)) for x in aliases if NOT {_FILLER.format(x='x')}]))"
_TOLD = f"""list_sort(list_distinct([{_BARE.format(x='x')} for x in regexp_split_to_array(regexp_replace(context_description, '([\\p{{L}}\\p{{N}})»"]{{2}}[.!?…])\\s+', '\\1' || chr(10), 'g'), '[|\\n\\r]+') if NOT {_FILLER.format(x='x')}]))"""
_VOTED = f"""r AS (SELECT *, coalesce(model, '') AS source FROM (SELECT DISTINCT ON (normalized_name, rec_id) * FROM graph_extraction_clean WHERE normalized_name IS NOT NULL AND rec_id IS NOT NULL)),
q AS (
  SELECT normalized_name, rec_id, updated_at, source, 'aliases' AS field, coalesce(array_to_string({_ALIASES}, chr(10)), '') AS normal, coalesce(len({_ALIASES}), 0)::DOUBLE AS quality FROM r
  UNION ALL SELECT normalized_name, rec_id, updated_at, source, 'confidence', CASE WHEN NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence::VARCHAR END, CASE WHEN NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence ELSE -1 END FROM r
  UNION ALL SELECT normalized_name, rec_id, updated_at, source, 'context_description', coalesce(array_to_string({_TOLD}, chr(10)), ''), coalesce(len({_TOLD}), 0) FROM r),
t AS (SELECT source, avg(CASE WHEN quality > 0 THEN 1.0 ELSE 0.0 END) AS trust FROM q GROUP BY 1),
v AS (SELECT q.*, trust * power(2.0, (epoch(coalesce(updated_at, TIMESTAMP '1970-01-01')) / 86400 - 20000) / {HALF_LIFE_DAYS}) AS vote FROM q JOIN t USING (source)),
s AS (SELECT *, round(sum(vote) OVER (PARTITION BY normalized_name, field, quality, normal), 9) AS votes, max(updated_at) OVER (PARTITION BY normalized_name, field, quality, normal) AS newest FROM v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY normalized_name, field ORDER BY quality DESC, votes DESC, newest DESC NULLS LAST, updated_at DESC NULLS LAST, rec_id) AS k, count(*) OVER (PARTITION BY normalized_name, field) AS n FROM s)"""
_OF = "max(CASE WHEN w.field = '{f}' THEN {x} END) AS {f}"
ORACLES = {
    "p3_found": f"""
WITH r AS (SELECT DISTINCT ON (normalized_name, rec_id) * FROM graph_extraction_clean WHERE normalized_name IS NOT NULL AND rec_id IS NOT NULL),
q AS (
  SELECT normalized_name, rec_id, updated_at, 'aliases' AS field,
    coalesce(len(list_distinct([lower(trim(x)) for x in aliases if NOT {_FILLER.format(x='x')}])), 0)::DOUBLE AS quality FROM r
  UNION ALL SELECT normalized_name, rec_id, updated_at, 'confidence', CASE WHEN NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence ELSE -1 END FROM r
  UNION ALL SELECT normalized_name, rec_id, updated_at, 'context_description',
    coalesce(len(list_distinct([{_BARE.format(x='x')} for x in
      regexp_split_to_array(regexp_replace(context_description, '([\\p{{L}}\\p{{N}})»"]{{2}}[.!?…])\\s+', '\\1' || chr(10), 'g'), '[|\\n\\r]+') if NOT {_FILLER.format(x='x')}])), 0) FROM r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY normalized_name, field ORDER BY quality DESC, updated_at DESC NULLS LAST, rec_id) AS k, count(*) OVER (PARTITION BY normalized_name, field) AS n FROM q)
SELECT normalized_name, field, rec_id FROM ranked WHERE k = 1 AND n > 1""",
    "p3_survivors": f"""WITH {_VOTED} SELECT w.normalized_name, {_OF.format(f='aliases', x=f"array_to_string({_ALIASES}, '; ')")}, {_OF.format(f='confidence', x='CASE WHEN NOT isnan(confidence) THEN confidence END')}, {_OF.format(f='context_description', x='context_description')}
FROM ranked w JOIN r ON r.normalized_name = w.normalized_name AND r.rec_id = w.rec_id WHERE k = 1 GROUP BY 1""",
}
