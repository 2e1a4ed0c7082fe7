"""Exports: attribute rows to wide tables, CSV lines, licence notices, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import ranking

#: Leading columns of an export and their headers.
LEADING_FIELDS = {
    "name": "Name", "email": "Email", "phone": "Phone", "website": "Website", "category": "Category", "address": "Address",
    "city": "City", "state": "State", "postal_code": "Postcode", "country": "Country", "rating": "Rating",
    "review_count": "Reviews", "instagram": "Instagram", "facebook": "Facebook", "linkedin": "LinkedIn",
    "whatsapp": "WhatsApp", "opening_hours": "Opening hours", "description": "Description",
}
BOM, CRLF = "﻿", "\r\n"


#: More fields than this are no table to export: the names are data that went astray.
MOST_FIELDS = 2_000


def fields_of(values: DataFrame) -> list[str]:
    """The fields present: the leading ones in their order, then the rest by name; an error beyond MOST_FIELDS."""
    present = {r[0] for r in values.select("field").where("field IS NOT NULL").distinct().limit(MOST_FIELDS + 1).collect()}
    if len(present) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields; name those to export")
    return [f for f in LEADING_FIELDS if f in present] + sorted(present - set(LEADING_FIELDS))


def wide(values: DataFrame, fields: list[str] | None = None, preset: str = "basic") -> DataFrame:
    """(lead_id, sources, one column for each field) of (lead_id, field, value, source, source_url, observed_at).

    Of several values of a field the newest counts, then the smallest. One pass and one shuffle; ``fields`` names the
    columns where the caller knows them. The preset ``sources`` adds each field's source, url and time.

    Survey: SNK5.
    """
    fields = fields or fields_of(values)
    newest = F.coalesce(-F.unix_micros(F.col("observed_at").try_cast("timestamp")), F.lit(2**62))  # values without a time come last
    cell = F.struct(newest.alias("newest"), "value", "source", "source_url", "observed_at")
    best = lambda f: F.min(F.when(F.col("field") == f, cell))
    sources = F.array_join(F.array_sort(F.collect_set(F.when(F.col("field").isin(fields), F.col("source")))), " | ")
    rows = values.groupBy("lead_id").agg(sources.alias("sources"), *(best(f).alias(f"_{i}") for i, f in enumerate(fields)))
    columns: list[Column] = []
    for i, f in enumerate(fields):
        columns.append(F.col(f"_{i}.value").alias(f))
        if preset == "sources":
            columns += [F.col(f"_{i}.source").alias(f"{f} source"), F.col(f"_{i}.source_url").alias(f"{f} source url"), F.col(f"_{i}.observed_at").alias(f"{f} observed at")]
    return rows.select("lead_id", "sources", *columns)


def csv_lines(table: DataFrame) -> DataFrame:
    """(line): each row as one CSV line, cells guarded and quoted. Survey: SNK4."""
    cells = [TX.csv_cell(F.col(f"`{c}`")) for c in table.columns]
    return table.select(F.concat(F.concat_ws(",", *cells), F.lit(CRLF)).alias("line"))


def header_line(fields: list[str], preset: str = "basic") -> str:
    names = ["lead_id", "sources"]
    for f in fields:
        name = LEADING_FIELDS.get(f, f.replace("_", " "))
        names += [name] + ([f"{name} source", f"{name} source url", f"{name} observed at"] if preset == "sources" else [])
    return BOM + ",".join(names) + CRLF


def notice_lines(values: DataFrame, obligations: DataFrame) -> DataFrame:
    """(source, notice) of the sources present, in the obligations' order. Survey: SNK6."""
    present = values.select("source").distinct()
    return obligations.join(present, "source", "left_semi").orderBy("ordinal").select("source", "notice")


def filename(job_id: Column, day: Column) -> Column:
    """Survey: SNK8."""
    return F.concat(F.lit("leads-"), F.substring(job_id, 1, 8), F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".csv"))


def storage_key(url_hash: Column, fetched_at: Column) -> Column:
    """Where a fetched body is kept. Survey: SNK2."""
    return F.concat(F.lit("raw/"), F.date_format(fetched_at, "yyyy/MM/"), url_hash, F.lit("/"), F.date_format(fetched_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit(".html.gz"))


def write_snapshot(df: DataFrame, root: str, version: str) -> None:
    """Writes a version folder and then points the one-row ``current`` table at it."""
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{root}/current")


def read_snapshot(spark, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{spark.read.parquet(f'{root}/current').first()[0]}")


def grouped_for_display(values: DataFrame, groups: DataFrame, other: str = "Other") -> DataFrame:
    """Adds heading and order: fields under their headings, unknown ones last. Survey: FLT29."""
    joined = values.join(groups.select("field", "heading", "ordinal"), "field", "left")
    return joined.withColumn("heading", F.coalesce("heading", F.lit(other))).withColumn("ordinal", F.coalesce("ordinal", F.lit(2**31 - 1)))


def page_of_leads(leads: DataFrame, companies: DataFrame, locations: DataFrame) -> DataFrame:
    """One row for each lead with its company and the oldest of its locations. Survey: JN3, WIN2."""
    oldest = ranking.first_per_key(locations, ["company_id"], [F.asc("location_id")])
    return leads.join(companies, "company_id").join(oldest, "company_id", "left")
