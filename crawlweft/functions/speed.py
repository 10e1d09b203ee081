"""Recorded answers of the speed API to metrics, and headers between JSON and maps; VARIANT and map columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Metric -> audit of the answer.
AUDITS = {"lcp_ms": "largest-contentful-paint", "fcp_ms": "first-contentful-paint", "cls": "cumulative-layout-shift", "tbt_ms": "total-blocking-time", "speed_index": "speed-index", "ttfb_ms": "server-response-time", "inp_ms": "interaction-to-next-paint"}


def psi_metrics(status_code: Column, body: Column) -> Column:
    """A struct of error (empty if there is none), score (0 to 100, cut), and the metrics of AUDITS, 0 where the answer lacks one.

    An answer without status 200, one that isn't a JSON object, or one whose numbers are no numbers is an error; its metrics are null.
    """
    answer = F.try_parse_json(body)
    at = lambda path, kind: F.try_variant_get(answer, path, kind)
    number = {name: f"$.lighthouseResult.audits['{audit}'].numericValue" for name, audit in AUDITS.items()} | {"score": "$.lighthouseResult.categories.performance.score"}
    # a value that is there but is no number fails the whole answer
    is_number = lambda path: F.coalesce(F.schema_of_variant(at(path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|VOID)"), F.lit(True))
    sound = F.schema_of_variant(answer).startswith("OBJECT")
    for path in number.values():
        sound = sound & is_number(path)
    error = F.when(status_code.isNull() | (status_code != 200), F.concat(F.lit("API returned status "), F.coalesce(status_code.cast("string"), F.lit("0")))).when(~F.coalesce(sound, F.lit(False)), "Failed to parse response").otherwise("")
    value = lambda path: F.when(error == "", F.coalesce(at(path, "double"), F.lit(0.0)))
    return F.struct(error.alias("error"), (value(number["score"]) * 100).cast("int").alias("score"), *(value(number[name]).alias(name) for name in AUDITS))


def headers_of(headers_json: Column) -> Column:
    """Stored headers as a map of name to values."""
    return F.from_json(headers_json, "map<string, array<string>>")


def header(headers: Column, name: str) -> Column:
    """All values of one header, by its exact name; empty without it."""
    return F.coalesce(F.array_join(F.try_element_at(headers, F.lit(name)), ", "), F.lit(""))
