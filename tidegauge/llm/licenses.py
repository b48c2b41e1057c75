"""License scan by canonical digests of entire texts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Licence texts, a file for each SPDX identifier.
TEXTS = Path(__file__).with_name("license_texts")

# Notices of one line, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

# Titles that may stand above a text.
TITLES = [
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT-0", "MIT No Attribution"), ("ISC", "ISC License"),
    ("ISC", "The ISC License"), ("0BSD", "BSD Zero Clause License"), ("0BSD", "Zero-Clause BSD"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("Zlib", "zlib License"), ("Zlib", "The zlib License"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
]

# Words that licence matching treats as one (first to second), after punctuation has become spaces.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"), ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("emphasis", "emphasiz"), ("favour", "favor"), ("fulfill", "fulfil"), ("https", "http"), ("initialis", "initializ"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximis", "maximiz"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("noninfringement", "non infringement"), ("offence", "offense"), ("optimis", "optimiz"),
    ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"),
    ("signalling", "signaling"), ("sub licens", "sublicens"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"), (" all rights reserved ", " "),
]

# Patterns of what may differ (both regular expression dialects read them alike), and what stands for it.
# A copyright line opens, after comment marks, with the word and a sign, or with either and, soon after it, a year or a place for one.
_YEAR = r"([12][09][0-9][0-9]|<year|\[year|\[yyyy|\{yyyy|year by)"
PATTERNS = [
    (r"(^|\n)[^\w\n(]*(copyright[ :]*(\(c\)|©)|(copyright|\(c\)|©)[^\n]?[^\n]?[^\n]?[^\n]?[^\n]?[^\n]?" + _YEAR + r")[^\n]*", r"\1"),
    (r"(^|\s)\(?([0-9][0-9]?|[a-z])[.)](\s)", r"\1\3"),
    (r"[^\p{L}\p{N}]+", " "),
    (r"neither the names? of .{1,80}? nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this software is provided by .{1,80}? as is", "this software is provided by the copyright holders and contributors as is"),
    (r"in no event shall .{1,80}? be liable", "in no event shall the copyright holder or contributors be liable"),
]


def canonical(text: Column) -> Column:
    """Lower case; copyright lines, list numbers and holders' names out; anything but letters and digits one space; one spelling."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in PATTERNS:
        out = F.regexp_replace(out, pattern, new.replace("\\", "$"))
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): every text, also under its titles and, where terms end before an appendix, without that; and the notices."""
    out = list(NOTICES)
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(path.stem, t) for t in dict.fromkeys([text, terms, terms + end] if end else [text])]
        out += [(path.stem, f"{title}\n\n{text}") for name, title in TITLES if name == path.stem]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, license_text string")


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs with digest (SHA-256 of the canonical text) and license_id, null where the text is no known licence.

    `known` has license_id and license_text; of known texts with one digest the smallest
    license_id stands. A null text counts as empty; an empty canonical text matches nothing. Repeated
    rows are each judged. Columns of docs named digest or license_id are replaced.
    """
    texts = known.where(F.col("license_text").isNotNull()).select(F.sha2(canonical(F.col("license_text")), 256).alias("digest"), "license_id")
    empty = F.sha2(F.lit(""), 256)
    found = texts.where(F.col("digest") != empty).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    scanned = docs.drop("digest", "license_id").withColumn("digest", F.sha2(canonical(F.col("text")), 256))
    return scanned.join(found, "digest", "left")


def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs, known_licenses(spark)).select("doc_id", "digest", "license_id")


def planted(spark, sf_dir):
    """Every document as it is, and again in place of a known text, wrapped anew, under a copyright line and between comment marks; which one goes by doc_id.

    Rewritten texts repeat, so each is scanned once and its verdict goes to all documents that it stands for.
    """
    known = known_texts()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rewrapped = F.concat(F.lit("# Copyright (c) 2019 Somebody Else\n# "), F.regexp_replace(F.upper("text"), r"[ \t]*\n[ \t]*", "\n * "))
    texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(known)], "k long, text string").withColumn("text", rewrapped)
    verdicts = license_scan(texts, known_licenses(spark)).select("k", "license_id")
    whole = license_scan(docs, known_licenses(spark)).select(F.lit(False).alias("licence"), "license_id")
    stood_for = docs.select((F.col("doc_id") % len(known)).alias("k")).join(F.broadcast(verdicts), "k").select(F.lit(True).alias("licence"), "license_id")
    return whole.union(stood_for).groupBy("licence", "license_id").agg(F.count("*").alias("n"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, new in PATTERNS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    out = f"(' ' || trim({out}) || ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"sha256(trim({out}))"


_KNOWN = f"texts(id, t) AS (VALUES {', '.join(f'({_quoted(k)}, {_quoted(t)})' for k, t in known_texts())}), known AS (SELECT {_sql('t')} AS digest, min(id) AS license_id FROM texts GROUP BY 1)"

ORACLE = f"""
WITH {_KNOWN}, d AS (SELECT doc_id, {_sql("text")} AS digest FROM documents)
SELECT doc_id, d.digest, license_id FROM d LEFT JOIN known USING (digest)
"""

PLANTED_ORACLE = f"""
WITH {_KNOWN}, named AS (SELECT row_number() OVER () - 1 AS k, t FROM texts), n AS (SELECT count(*) AS n FROM texts),
d AS (SELECT false AS licence, {_sql("text")} AS digest FROM documents
  UNION ALL SELECT true, {_sql("'# Copyright (c) 2019 Somebody Else' || chr(10) || '# ' || regexp_replace(upper(t), '[ \\t]*\\n[ \\t]*', chr(10) || ' * ', 'g')")} FROM documents CROSS JOIN n JOIN named ON k = doc_id % n.n)
SELECT licence, license_id, count(*) AS n FROM d LEFT JOIN known USING (digest) GROUP BY ALL
"""
