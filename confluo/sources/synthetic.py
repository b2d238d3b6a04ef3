"""Synthetic people for tests and timing: each is in one tabular and in one JSON source, under the same address and number.

Everything follows from a person's number, so any file can be made anywhere: a source is one row of a range, and its text
is built from the numbers of its people, without a shuffle.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ["Amara", "Björn", "Clio", "Dov", "Esme", "Farid", "Gwen", "Hugo", "Ines", "Joon", "Kaia", "Leif"]
FAMILY = ["Abara", "Brandt", "Castellan", "Duval", "Eriksen", "Fontaine", "Grimaldi"]
EMPLOYERS = ["Harbour Analytics Ltd", "Copperfield GmbH", "Osprey Freight", "Tidewater Health Inc", "Meridian Press"]
ROLES = ["Analyst", "Platform Engineer", "Translator", "Site Manager"]
TOWNS = [("Lyon", "France", "FR"), ("Leeds", "England", "GB"), ("Porto", "Portugal", "PT"), ("Graz", "Austria", "AT")]
SCHOOLS = ["Universidade do Porto", "TU Graz", "Leeds Beckett"]
SHARED, TABULAR, OTHER = ["SQL", "Python", "Rust"], ["golang", "k8s", "Falconry"], ["ML", "docker"]
HEADER = "Based In,Key Skills,Candidate Name,Designation,Mobile Number,Email Address,Employer"


def _of(values: list[str], i: Column, stride: int = 1) -> Column:
    return F.get(F.array(*map(F.lit, values)), ((i * stride) % len(values)).cast("int"))


def _address(i: Column) -> Column:
    return F.concat(F.lit("p"), F.lower(F.conv(i.cast("string"), 10, 36)), F.lit("@people.example"))


def _number(i: Column) -> Column:
    """Nine digits after the calling code 44."""
    return F.concat(F.lit("7"), F.lpad((i + 400_000_000).cast("string"), 9, "0"))


def _line(i: Column) -> Column:
    """A row of the table, in the order of ``HEADER``."""
    town = F.concat_ws(", ", _of([t for t, _, _ in TOWNS], i), _of([c for _, c, _ in TOWNS], i))
    skills = F.concat_ws(" | ", _of(SHARED, i), _of(TABULAR, i))
    name = F.concat_ws(", ", _of(FAMILY, i), _of(GIVEN, i))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat_ws(",", quoted(town), skills, quoted(name), _of(ROLES, i, 3), F.concat(F.lit("+44"), _number(i)), F.upper(_address(i)), _of(EMPLOYERS, i))


def _object(i: Column) -> Column:
    n = _number(i)
    spelled = F.concat(F.lit("00 44 "), F.substring(n, 1, 4), F.lit("-"), F.substring(n, 5, 6))
    job = F.struct(_of(EMPLOYERS, i).alias("organization"), _of(ROLES, i, 3).alias("job_title"), F.concat((2010 + i % 9).cast("string"), F.lit("/04")).alias("start_date"), F.lit("now").alias("end_date"))
    school = F.struct(_of(SCHOOLS, i).alias("university"), F.lit("MSc").alias("qualification"), (2001 + i % 9).alias("grad_year"))
    return F.struct(
        _of(GIVEN, i).alias("given_name"), _of(FAMILY, i).alias("family_name"), _address(i).alias("email_address"), spelled.alias("contact_number"), _of(ROLES, i, 3).alias("role"),
        F.struct(_of([t for t, _, _ in TOWNS], i).alias("town"), _of([c for _, _, c in TOWNS], i).alias("country_code")).alias("geo"),
        F.array(_of(SHARED, i), _of(OTHER, i)).alias("competencies"), F.array(job).alias("positions"), F.array(school).alias("academics"),
    )


def sources(spark: SparkSession, n: int, per_file: int = 500) -> DataFrame:
    """Two sources for each ``per_file`` people."""
    count = -(-n // per_file)
    files = spark.range(0, count, 1, max(1, min(count, spark.sparkContext.defaultParallelism)))
    ids = F.sequence(F.col("id") * per_file, F.least(F.lit(n), (F.col("id") + 1) * per_file) - 1)
    table = F.concat(F.lit(HEADER + "\r\n"), F.array_join(F.transform(ids, _line), "\r\n"))
    objects = F.concat(F.lit('{"applicants":'), F.to_json(F.transform(ids, _object)), F.lit("}"))
    source = lambda k, kind, name, content: F.struct((F.col("id") * 2 + k).alias("source_ord"), F.lit(kind).alias("type"), F.format_string(name, "id").alias("name"), content.alias("content"))
    both = F.array(source(0, "csv", "table-%05d.csv", table), source(1, "ats_json", "objects-%05d.json", objects))
    return files.select(F.explode(both).alias("s")).select("s.source_ord", "s.type", "s.name", F.col("s.name").alias("path"), "s.content")


def write(spark: SparkSession, n: int, folder: str, per_file: int = 500) -> list[str]:
    """The sources of ``n`` people as files of a local folder, one at a time; ``python -m confluo.sources.synthetic N FOLDER``."""
    made = []
    os.makedirs(folder, exist_ok=True)
    for s in sources(spark, n, per_file).orderBy("source_ord").toLocalIterator():
        made.append(os.path.join(folder, s["name"]))
        with open(made[-1], "w", encoding="utf-8", newline="") as f:
            f.write(s["content"])
    return made


if __name__ == "__main__":
    print(*write(SparkSession.builder.getOrCreate(), int(sys.argv[1]), sys.argv[2]), sep="\n")
