"""Licence scan by canonical digest.

A text and a licence are the same when they are after normalisation: letters in lower
case, copyright lines dropped, equivalent spellings made one, and everything but
letters and digits made one space. The whole normalised text is hashed and joined with
the digests of the known licences. There is no Python and no shuffle of texts: a table of
licences below Spark's broadcast threshold is broadcast, a larger one joins by digest.

* A null text has a null digest and no licence. A text of which nothing is left has
  the digest of the empty text and no licence.
* Every input row has one row, repeated rows too. A digest that several licences have is
  the one first in the alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.llm.license_texts import LICENSES

#: Spellings that mean the same in licence texts, and the one that is used.
EQUIVALENT = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infring", "noninfring"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("honour", "honor"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"),
    ("merchantibility", "merchantability"), ("modelling", "modeling"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"),
]
#: A header line: it begins with a copyright mark, or with "Copyright" and names a holder or a year, in any order; or it says
#: that all rights are reserved. A wrapped line of a licence that begins with the word, as "copyright notice", is none.
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n]*((?i:copyright)[ \t]*(\([cC]\)|©|:|[0-9])|(Copyright|COPYRIGHT)\b[^\n]*\b(19|20)[0-9]{2}\b"
                  r"|Copyright[ \t]+(?!(Holders?|Owners?|Licen[sc]es?|Notices?|Laws?|Acts?|Rights?)\b)\p{Lu}|\([cC]\)|©|(?i:all rights reserved))[^\n]*$")
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The normalised text."""
    lowered = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    for spelling, used in EQUIVALENT:
        lowered = F.replace(lowered, F.lit(spelling), F.lit(used))
    return F.trim(F.regexp_replace(lowered, NOT_WORD, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(licenses: DataFrame) -> DataFrame:
    """``digest`` and ``license_id`` of a table of ``license_id`` and ``text``."""
    return (licenses.where(canonical(F.col("text")) != "").select(digest(F.col("text")).alias("digest"), "license_id")
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``digest`` and ``license_id`` (null for other texts) of every row."""
    if licenses is None:
        schema = T.StructType([T.StructField("license_id", T.StringType()), T.StructField("text", T.StringType())])
        licenses = docs.sparkSession.createDataFrame(LICENSES, schema)
    marked = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return marked.join(known_digests(licenses), "digest", "left").select("doc_id", "digest", "license_id")


def oracle_sql() -> str:
    """The scan of ``documents`` in SQL, written apart: line by line and word by word."""
    spellings = {
        "licence": "license", "sub-license": "sublicense", "sub license": "sublicense", "non-infring": "noninfring", "acknowledgement": "acknowledgment",
        "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
        "favour": "favor", "fulfilment": "fulfillment", "honour": "honor", "initialise": "initialize", "judgement": "judgment", "labour": "labor",
        "merchantibility": "merchantability", "modelling": "modeling", "organisation": "organization", "organise": "organize",
        "practise": "practice", "programme": "program", "recognise": "recognize", "utilisation": "utilization", "whilst": "while",
        "wilful": "willful", "copyright owner": "copyright holder",
    }
    start = "regexp_replace(line, '^[^\\p{L}\\p{N}]*', '')"
    header = f"""(regexp_matches(lower({start}), '^copyright[ \\t]*(\\(c\\)|©|:|[0-9])')
        OR (regexp_matches({start}, '^(Copyright|COPYRIGHT)([^\\p{{L}}\\p{{N}}_]|$)') AND regexp_matches({start}, '(^|[^0-9A-Za-z_])(19|20)[0-9][0-9]([^0-9A-Za-z_]|$)'))
        OR (regexp_matches({start}, '^Copyright[ \\t]+\\p{{Lu}}')
            AND NOT regexp_matches({start}, '^Copyright[ \\t]+(Holder|Holders|Owner|Owners|License|Licence|Licenses|Licences|Notice|Notices|Law|Laws|Act|Acts|Right|Rights)([^0-9A-Za-z_]|$)'))
        OR regexp_matches(lower(line), '^[^\\p{{L}}\\p{{N}}]*(\\(c\\)|©|all rights reserved)'))"""

    def normal(text: str) -> str:
        out = f"lower(array_to_string(list_transform(string_split({text}, chr(10)), lambda line: CASE WHEN {header} THEN '' ELSE line END), chr(10)))"
        for spelling, used in spellings.items():
            out = f"replace({out}, '{spelling}', '{used}')"
        return f"array_to_string(regexp_extract_all({out}, '[\\p{{L}}\\p{{N}}]+'), ' ')"

    rows = ", ".join("('{}', '{}')".format(*(part.replace("'", "''") for part in row)) for row in LICENSES)
    return f"""
        WITH known AS (
            SELECT sha256({normal('text')}) AS digest, min(license_id) AS license_id
            FROM (VALUES {rows}) AS k(license_id, text) GROUP BY 1
        ), marked AS (
            SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256({normal('text')}) END AS digest FROM documents
        )
        SELECT doc_id, digest, license_id FROM marked LEFT JOIN known USING (digest)
    """
