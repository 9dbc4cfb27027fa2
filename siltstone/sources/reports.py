"""Reports read strictly from their bytes."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.rules.reports import ERROR, NUMBERED, TOOL

#: Bytes of a report at most.
MOST_BYTES = 5 << 20

#: The shape of a report: the keys an object has, all of them and no others, and the types of values.
_SHAPE = {
    "schema_version": "version",
    "target": {"files": ["text"], "cdk": {"detected": "truth", "synthesis": "text", "synthesized_templates": ["text"]}},
    "sources_enabled": ["text"],
    "tools": [{"name": "text", "available": "truth", "version": "text?"}],
    "errors": [{k: "text" for k in ("error_class", "message")} | {k: "text?" for k in ("source", "tool", "required_min_version", "detected_version", "remediation")} | {"exit_code": "whole?", "stderr_head": ["text"]}],
    "findings": [
        {"ID": "whole", **{k: "text" for k in ("Normalized_Category", "FindingType", "Severity", "Confidence", "Finding", "WhyItMatters", "Recommendation")}, "Resource": "text?", "SuggestedRemediation": "text?", "Source": ["text"],
         "Location": {"File": "text", "Line": "whole?", "Column": "whole?", "TemplatePath": "steps?"}, "Evidence": [{"Source": "text", "Detail": "text", "RuleId": "text?", "Excerpt": "text?"}]}
    ],
    "summary": "object",
}
_TYPES = {"text": str, "truth": bool, "object": dict}

#: What is passed on of a report that has its shape.
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
_CDK = T.StructType().add("detected", T.BooleanType()).add("synthesis", _TEXT).add("synthesized_templates", _TEXTS)
BODY = T.StructType().add("target", T.StructType().add("files", _TEXTS).add("cdk", _CDK)).add("sources_enabled", _TEXTS).add("tools", T.ArrayType(TOOL)).add("errors", T.ArrayType(ERROR)).add("findings", T.ArrayType(NUMBERED))


class _Refused(Exception):
    """A report that can't be taken, with the code."""


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _Refused("duplicate_key")
    return found


def _finite(literal: str) -> float:
    value = float(literal)
    if not math.isfinite(value):
        raise _Refused("parse_failure")
    return value


def _constant(_: str) -> float:
    raise _Refused("parse_failure")


def misshapen(value: object, shape: object, path: str = "") -> str | None:
    """The first place, in the order of the shape, at which a value doesn't have it; None if it has."""
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return path
        at = lambda k: f"{path}.{k}" if path else k
        if missing := next((k for k in shape if k not in value), None):
            return at(missing)
        if len(value) > len(shape):
            return path
        return next((bad for k, s in shape.items() if (bad := misshapen(value[k], s, at(k))) is not None), None)
    if isinstance(shape, list):
        if not isinstance(value, list):
            return path
        return next((bad for i, x in enumerate(value) if (bad := misshapen(x, shape[0], f"{path}[{i}]")) is not None), None)
    if shape.endswith("?"):
        if value is None:
            return None
        shape = shape[:-1]
    whole = isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63
    if shape == "whole":
        return None if whole else path
    if shape == "steps":
        return None if isinstance(value, list) and all(isinstance(x, (str, int)) and not isinstance(x, bool) for x in value) else path
    if shape == "version":
        parts = value.split(".") if isinstance(value, str) else []
        return None if len(parts) == 3 and all(p.isascii() and p.isdigit() for p in parts) and int(parts[0]) == 1 else path
    return None if isinstance(value, _TYPES[shape]) else path


def _row(raw: bytes) -> dict:
    out = dict.fromkeys(("failure", "line", "column", "field", "dumped", "body")) | {"sha256": hashlib.sha256(raw).hexdigest()}
    if len(raw) > MOST_BYTES:
        return out | {"failure": "too_large"}
    try:
        found = json.loads(raw.decode(), object_pairs_hook=_once, parse_constant=_constant, parse_float=_finite)
    except _Refused as error:
        return out | {"failure": str(error)}
    except json.JSONDecodeError as error:
        return out | {"failure": "parse_failure", "line": error.lineno, "column": error.colno}
    except (ValueError, RecursionError):
        return out | {"failure": "parse_failure"}
    bad = misshapen(found, _SHAPE)
    if bad is not None:
        return out | {"failure": "schema_violation", "field": bad}
    out["dumped"] = json.dumps(found, sort_keys=True, ensure_ascii=False, indent=2) + "\n"
    for f in found["findings"]:
        steps = f["Location"]["TemplatePath"]
        f["Location"]["TemplatePath"] = steps and [{"json": json.dumps(s, ensure_ascii=False)} for s in steps] if steps != [] else []
    return out | {"body": found}


def read(reports: DataFrame, id_col: str = "report_id", raw_col: str = "raw") -> DataFrame:
    """(report_id, sha256, failure, line, column, field, dumped, body) of reports as bytes.

    Refused are reports of more than MOST_BYTES (too_large), what is no UTF-8 or JSON or holds a number that is not finite
    (parse_failure, with line and column where they are known), objects that name a key twice (duplicate_key), and values of
    another shape than a report (schema_violation, with the first field). dumped is the canonical text of what was read. Null
    bytes are empty ones, which are no JSON. A report that can't be read is a row like others and stops nothing.
    """
    schema = T.StructType().add("report_id", reports.schema[id_col].dataType).add("sha256", _TEXT).add("failure", _TEXT).add("line", T.LongType()).add("column", T.LongType()).add("field", _TEXT).add("dumped", _TEXT).add("body", BODY)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(r or b"") for r in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return reports.select(F.col(id_col), F.col(raw_col).cast("binary")).mapInArrow(run, schema)
