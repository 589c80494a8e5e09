"""Token estimates and usage records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segqa.functions.text import let

# Where a response may carry usage, in order of preference, and the
# names its counts go by.
USAGE_PATHS = (
    "$.usage_metadata", "$.token_usage", "$.usage", "$.response_metadata.token_usage", "$.response_metadata.usage",
)
INPUT_NAMES = ("input_tokens", "prompt_tokens", "input_token_count")
OUTPUT_NAMES = ("output_tokens", "completion_tokens", "output_token_count")
TOTAL_NAMES = ("total_tokens", "total_token_count")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def estimate_request(payload: Column, prompt: str, schema: str) -> Column:
    """Tokens of a request: prompt, payload and the schema of the answer."""
    return F.greatest(F.lit(1), F.floor((F.length(payload) + len(prompt) + len(schema)) / 4).cast("int"))


# A response with all these places, read in one pass; counts may be numbers or strings.
_COUNTS = "struct<" + ",".join(f"{n}:string" for n in (*INPUT_NAMES, *OUTPUT_NAMES, *TOTAL_NAMES)) + ">"
_RESPONSE = (
    f"usage_metadata {_COUNTS}, token_usage {_COUNTS}, usage {_COUNTS}, "
    f"response_metadata struct<token_usage:{_COUNTS},usage:{_COUNTS}>"
)


def _at(response: Column, path: str) -> Column:
    for name in path.removeprefix("$.").split("."):
        response = response[name]
    return response


def _first_count(usage: Column, names: tuple[str, ...]) -> Column:
    """First of ``names`` that holds a number; fractions are cut, absent counts are 0."""
    def number(name: str) -> Column:
        value = usage[name]
        return F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.cast("double").cast("bigint"))

    return F.coalesce(*[number(n) for n in names], F.lit(0).cast("bigint"))


def _usable(usage: Column) -> Column:
    """(input, output, total) of one candidate, or null when nothing was counted."""
    def build(c: Column) -> Column:
        total = F.when(c["t"] == 0, c["i"] + c["o"]).otherwise(c["t"])
        counts = F.struct(c["i"].alias("input_tokens"), c["o"].alias("output_tokens"), total.alias("total_tokens"))
        return F.when((c["i"] != 0) | (c["o"] != 0) | (total != 0), counts)

    counts = F.struct(
        _first_count(usage, INPUT_NAMES).alias("i"),
        _first_count(usage, OUTPUT_NAMES).alias("o"),
        _first_count(usage, TOTAL_NAMES).alias("t"),
    )
    return let(counts, build)


def extract_usage(raw: Column, provider: str, model: str, operation: str) -> Column:
    """Usage struct from a raw response in JSON, or null when it reports none."""
    found = let(F.from_json(raw, _RESPONSE), lambda r: F.coalesce(*[_usable(_at(r, path)) for path in USAGE_PATHS]))
    return let(
        found,
        lambda u: F.when(
            u.isNotNull(),
            F.struct(
                F.lit(provider).alias("provider"),
                F.lit(model).alias("model"),
                F.lit(operation).alias("operation"),
                u["input_tokens"].alias("input_tokens"),
                u["output_tokens"].alias("output_tokens"),
                u["total_tokens"].alias("total_tokens"),
            ),
        ),
    )
