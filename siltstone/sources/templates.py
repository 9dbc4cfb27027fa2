"""Nested YAML and JSON templates as relations.

Documents are parsed once, in parallel by file, into a table of nodes in source order, with what a plain parser loses:
repeated keys, the order of keys, and the types of scalars. All else is DataFrame code on that table.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.settle import settled

try:
    import yaml
except ModuleNotFoundError:  # YAML documents then come out as error rows
    yaml = None

#: Limits of one document; beyond them it is refused with a reason.
MAX_BYTES, MAX_DEPTH, MAX_NODES, MAX_ALIASES, MAX_JSON_DEPTH = 5 << 20, 64, 3_000_000, 10_000, 512
#: Nodes after which a task passes its rows on, whole documents at a time.
PASSED = 50_000
#: Bytes of text that a task parses: many times as many as rows of nodes come of them.
TASK_BYTES = 2 << 20
NODES = "template_id string, path array<string>, shape string, ord bigint, vtype string, sval string, dup_key boolean, error string"
#: What nodes() adds if asked to: the place of each step of a path among its siblings, and how many entries a node holds itself.
PLACES = "places array<int>, entries int"

# Short tags and their long names; those not listed take "Fn::" before the tag.
_PLAIN_TAGS = {"Ref": "Ref", "Condition": "Condition"}
_FUNCTION_TAGS = "And Base64 Cidr Equals FindInMap GetAtt GetAZs If ImportValue Join Length Not Or Select Split Sub ToJsonString Transform ForEach".split()


class Refused(ValueError):
    """Why a document is not read."""


class _Map(list):
    """Pairs of a mapping in order, repeated keys kept."""


def _with_merged(own: _Map, merged: list[_Map]) -> _Map:
    """The pairs of a mapping with those of the mappings that it takes in: its own keys go first, then the first to have a key.

    A key that is repeated in the mapping that gives it comes out repeated.
    """
    taken, out = {str(k) for k, _ in own}, _Map()
    for other in merged:
        keys = {str(k) for k, _ in other}
        out += [(k, v) for k, v in other if str(k) not in taken]
        taken |= keys
    return _Map([*out, *own])


def _parts(value) -> list | None:  # noqa: ANN001
    """What a container holds, of a YAML node or a JSON value; None for a leaf."""
    if isinstance(value, _Map):
        return [v for _, v in value]
    if isinstance(value, list):
        return value
    if yaml is not None and isinstance(value, yaml.MappingNode):
        return [v for _, v in value.value]
    return value.value if yaml is not None and isinstance(value, yaml.SequenceNode) else None


def structure(root: object) -> tuple[str | None, int, int]:
    """Why a document is too large, its nodes and its depth as if all aliases were written out, without doing so.

    A container that aliases share is measured once: its nodes are the sum of its parts', its depth one more than the deepest.
    Told in this order: an alias to what holds it, too great a depth, too many nodes. Nodes and depth are told up to one more
    than may be.
    """
    if _parts(root) is None:
        return None, 1, 1
    measured: dict[int, tuple[int, int]] = {}
    open_ = {id(root)}
    stack = [(root, iter(_parts(root)), [1, 1])]
    while stack:
        value, rest, sums = stack[-1]
        n, depth = sums
        for part in rest:
            known = measured.get(id(part))
            if known is None and (inner := _parts(part)) is not None:
                if id(part) in open_:
                    return "an alias refers to what holds it", 0, 0
                open_.add(id(part))
                stack.append((part, iter(inner), [1, 1]))
                break
            parts, deep = known or (1, 1)
            n += parts
            if deep >= depth:
                depth = deep + 1
        sums[0], sums[1] = min(n, MAX_NODES + 1), min(depth, MAX_DEPTH + 1)
        if stack[-1][0] is value:  # all parts are measured
            stack.pop()
            open_.discard(id(value))
            measured[id(value)] = sums[0], sums[1]
            if stack:
                above = stack[-1][2]
                above[0], above[1] = min(above[0] + sums[0], MAX_NODES + 1), max(above[1], min(sums[1] + 1, MAX_DEPTH + 1))
    n, depth = measured[id(root)]
    return "nested too deeply" if depth > MAX_DEPTH else "too many nodes" if n > MAX_NODES else None, n, depth


def _nesting(text: str) -> int:
    """How deep brackets are nested outside of strings; where so few are opened that it can't be too deep, how many."""
    opened = text.count("[") + text.count("{")
    if opened <= MAX_JSON_DEPTH:
        return opened
    depth = most = 0
    for bracket in re.findall(r"[\[\]{}]", re.sub(r'"[^"\\]*(?:\\.[^"\\]*)*"', "", text, flags=re.DOTALL)):
        depth += 1 if bracket in "[{" else -1
        most = max(most, depth)
    return most


def _from_json(text: str):  # noqa: ANN202
    if _nesting(text) > MAX_JSON_DEPTH:
        raise Refused("nested too deeply")
    try:
        return json.loads(text, object_pairs_hook=_Map)
    except RecursionError:
        raise Refused("nested too deeply") from None
    except ValueError as error:
        raise Refused(f"malformed JSON: {error}") from None


def _from_yaml(text: str):  # noqa: ANN202
    if yaml is None:
        raise Refused("no YAML parser")
    try:
        root = yaml.compose(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, RecursionError) as error:
        mark = getattr(error, "problem_mark", None)
        at = f" at line {mark.line + 1}, column {mark.column + 1}" if mark else ""
        raise Refused(f"malformed YAML{at}: {getattr(error, 'problem', error)}") from None
    why, n, _ = structure(root) if root is not None else (None, 0, 0)
    if why and n <= MAX_NODES:  # too many nodes by aliases end the building below, after MAX_ALIASES of them
        raise Refused(why)
    scalars, open_nodes, seen, done, aliases = yaml.SafeLoader(""), set(), [0], set(), [0]

    def build(node, depth: int):  # noqa: ANN001, ANN202
        seen[0] += 1
        if seen[0] > MAX_NODES:
            raise Refused("too many nodes")
        if depth > MAX_DEPTH:
            raise Refused("nested too deeply")
        if id(node) in open_nodes:
            raise Refused("an alias refers to what holds it")
        tag = node.tag[1:] if node.tag.startswith("!") else ""
        if tag and tag not in _PLAIN_TAGS and tag not in _FUNCTION_TAGS:
            raise Refused(f"unsupported tag !{tag}")
        if id(node) in done and not isinstance(node, yaml.ScalarNode):
            aliases[0] += 1
            if aliases[0] > MAX_ALIASES:
                raise Refused("too many aliases")
        done.add(id(node))
        open_nodes.add(id(node))
        if isinstance(node, yaml.MappingNode):
            made, merged = _Map(), []
            for k, v in node.value:
                if k.tag == "tag:yaml.org,2002:merge":
                    given = build(v, depth + 1)
                    given = given if isinstance(given, list) and not isinstance(given, _Map) else [given]
                    if not all(isinstance(x, _Map) for x in given):
                        raise Refused("a merge of what is no mapping")
                    merged += given
                else:
                    made.append((build(k, depth + 1), build(v, depth + 1)))
            made = _with_merged(made, merged) if merged else made
        elif isinstance(node, yaml.SequenceNode):
            made = [build(x, depth + 1) for x in node.value]
        elif tag:
            made = node.value
        else:
            made = scalars.construct_object(node)
        open_nodes.discard(id(node))
        if tag == "GetAtt" and isinstance(made, str):
            made = made.split(".", 1)
        return _Map([(_PLAIN_TAGS.get(tag, f"Fn::{tag}"), made)]) if tag else made

    return None if root is None else build(root, 0)


def _scalar(value) -> tuple[str, str | None]:  # noqa: ANN001
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "bool", str(value).lower()
    if isinstance(value, int):
        return "int", str(value)
    if isinstance(value, float):
        return "float", repr(value)
    if isinstance(value, bytes):
        return "bytes", value.hex()
    if hasattr(value, "hour"):
        return "timestamp", value.isoformat()
    if hasattr(value, "isoformat"):
        return "str", value.isoformat()
    return "str", str(value)


def nodes_of(template_id: str, text: str) -> list[tuple]:
    """Rows of one document: its nodes from the top in source order, or one row with the error."""
    try:
        if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
            raise Refused("too large")
        body = text.removeprefix("﻿")
        start = body.lstrip()[:1]
        if not start:
            raise Refused("empty document")
        document = _from_json(body) if start in "{[" else _from_yaml(body)
        rows: list[tuple] = []

        def walk(value, path: list[str], shape: str, dup: bool) -> None:  # noqa: ANN001
            if len(path) > MAX_DEPTH:
                raise Refused("nested too deeply")
            if len(rows) >= MAX_NODES:
                raise Refused("too many nodes")
            at = len(rows)
            if isinstance(value, _Map):
                rows.append((template_id, path, shape, at, "map", None, dup, None))
                keys = [str(k) for k, _ in value]
                last = {k: i for i, k in enumerate(keys)}
                repeated = {k for i, k in enumerate(keys) if last[k] != i}
                for i, (k, v) in enumerate(zip(keys, (v for _, v in value), strict=True)):
                    if last[k] == i:  # the last of repeated keys counts, and is marked
                        walk(v, [*path, k], f"{shape}/{k}" if shape else k, k in repeated)
            elif isinstance(value, list):
                rows.append((template_id, path, shape, at, "list", None, dup, None))
                for i, v in enumerate(value):
                    walk(v, [*path, str(i)], f"{shape}/*", False)
            else:
                rows.append((template_id, path, shape, at, *_scalar(value), dup, None))

        walk(document, [], "", False)
        return rows
    except Refused as refused:
        return [(template_id, [], "", 0, "error", None, False, str(refused))]
    except Exception as error:  # noqa: BLE001  one document's fault is its own row, never the job's
        return [(template_id, [], "", 0, "error", None, False, f"unreadable value: {type(error).__name__}")]


def with_places(rows: list[tuple]) -> list[tuple]:
    """Rows of one document as nodes_of() gives them, each with its PLACES: in a mapping 0, 1, 2 and on, in a list -1, -2, -3."""
    above: list[tuple[list[int], bool]] = []
    places, entries, held = [], [0] * len(rows), []
    for at, row in enumerate(rows):
        deep = len(row[1])
        del above[deep:], held[deep:]
        own: list[int] = []
        if deep:
            up, is_map = above[-1]
            n = entries[held[-1]]
            entries[held[-1]] += 1
            own = [*up, n if is_map else -1 - n]
        places.append(own)
        above.append((own, row[4] == "map"))
        held.append(at)
    return [(*row, p, n) for row, p, n in zip(rows, places, entries, strict=True)]


def spread(templates: DataFrame) -> DataFrame:
    """(template_id, text) dealt over tasks of about TASK_BYTES of text each, however few files they come from.

    Small files hold many templates, and what is parsed is much larger: the tasks that read them would not grow in number with
    the input, and all that reads the parsed table would have as few. The texts are measured first; a stream's stay as they come.
    """
    texts = templates.select(F.col("template_id").cast("string"), F.col("text").cast("string"))
    if texts.isStreaming:
        return texts
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return texts.repartition(math.ceil(total / TASK_BYTES) or 1, "template_id", "text")


def nodes(templates: DataFrame, places: bool = False, dealt: bool = False) -> DataFrame:
    """The node table of a table (template_id, text); a refused document gives one row of vtype "error".

    places adds the columns of PLACES. Templates that are dealt over tasks already are parsed where they are.
    """
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = f"{NODES}, {PLACES}" if places else NODES
    columns = [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        values = zip(*rows, strict=True) if rows else [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, columns, strict=True)], [name for name, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for template_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = nodes_of(template_id, text or "")
                rows += with_places(found) if places else found
                if len(rows) >= PASSED:
                    yield made(rows)
                    rows = []
            yield made(rows)

    texts = templates.select(F.col("template_id").cast("string"), F.col("text").cast("string")) if dealt else spread(templates)
    return texts.mapInArrow(run, schema)


def structures(templates: DataFrame) -> DataFrame:
    """(template_id, failure, n_nodes, depth): how large documents are with their aliases written out, which is not done.

    failure tells why a document is not taken, as nodes() does; where it can't be read, or an alias refers to what holds it, the
    numbers are 0. Null texts are empty documents.
    """

    def measure(text: str) -> tuple:
        try:
            if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
                raise Refused("too large")
            body = text.removeprefix("\ufeff")
            start = body.lstrip()[:1]
            if not start:
                raise Refused("empty document")
            return structure(_from_json(body) if start in "{[" else yaml.compose(body, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))
        except Refused as refused:
            return str(refused), 0, 0
        except Exception as error:  # noqa: BLE001  one document's fault is its own row, never the job's
            return f"unreadable: {type(error).__name__}", 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.int64(), pa.int32()), strict=True))], ["template_id", "failure", "n_nodes", "depth"])

    return spread(templates).mapInArrow(run, "template_id string, failure string, n_nodes bigint, depth int")


def reviewable(table: DataFrame) -> DataFrame:
    """(template_id, reviewable): whether a document of a node table is a mapping whose Resources is a mapping with an entry."""
    top = F.get("path", F.lit(0)) == "Resources"
    has = F.bool_or((F.size("path") == 0) & (F.col("vtype") == "map")) & F.bool_or(top & (F.size("path") == 1) & (F.col("vtype") == "map")) & F.bool_or(top & (F.size("path") == 2))
    return table.groupBy("template_id").agg(F.coalesce(has, F.lit(False)).alias("reviewable"))


class Relations:
    """The relations of a node table that rules work on. The table should be settled: every rule reads it."""

    def __init__(self, table: DataFrame):
        self.nodes = table.where("vtype != 'error'")
        self.errors = table.where("vtype = 'error'").select("template_id", "error")
        self._table = table
        own = self.nodes.where("get(path, 0) = 'Resources' and size(path) >= 2").withColumn("logical_id", F.get("path", F.lit(1)))
        depth = F.size("path")
        first = lambda key: F.max(F.when((depth == 3) & (F.get("path", F.lit(2)) == key), F.col("sval")))
        heads = own.where((depth == 2) | (depth == 3) & F.get("path", F.lit(2)).isin("Type", "Condition", "DeletionPolicy"))  # a resource comes before what is in it
        self._resources = heads.groupBy("template_id", "logical_id").agg(F.min("ord").alias("ord"), first("Type").alias("type"), first("Condition").alias("condition"), first("DeletionPolicy").alias("deletion_policy"))
        #: One row a node under a resource, its place within the resource as text with * for list places.
        self.props = own.where(depth > 2).select("template_id", "logical_id", "ord", "vtype", "sval", F.array_join(F.slice("path", 3, 100), "/").alias("place"), F.substr("shape", F.length("logical_id") + len("Resources//1")).alias("prop"), "path")

    @cached_property
    def resources(self) -> DataFrame:
        """(template_id, logical_id, ord, type, condition, deletion_policy), settled: a row a resource, which most rules join."""
        return settled(self._resources)

    @cached_property
    def tasks(self) -> int:
        """Tasks that the table is dealt over: a shuffle of its rows into as many holds no more in a task, however well they compress."""
        return self._table.rdd.getNumPartitions()

    def section(self, name: str) -> DataFrame:
        """(template_id, name, ord, vtype, sval) of the entries of a section."""
        return self.nodes.where((F.size("path") == 2) & (F.get("path", F.lit(0)) == name)).select("template_id", F.get("path", F.lit(1)).alias("name"), "ord", "vtype", "sval")

    def edges(self, include_sub: bool = False, scope: str = "Properties", with_order: bool = False) -> DataFrame:
        """Distinct (template_id, src, dst) by Ref, GetAtt and DependsOn between resources of a template; Sub if asked for.

        with_order adds (late, ord): references in properties come before DependsOn, each kind in order of its first place.
        """
        key = F.element_at("path", -1)
        under = (F.size("path") > 3) & (F.get("path", F.lit(2)) == scope) if scope else F.lit(True)
        prop, text = F.col("prop"), F.col("vtype") == "str"
        dep = (F.get("path", F.lit(2)) == "DependsOn") & text & prop.isin("DependsOn", "DependsOn/*")
        targets = F.when(under & (key == "Ref") & text, F.array("sval"))
        targets = targets.when(under & ((key == "0") & prop.endswith("Fn::GetAtt/*") | prop.endswith("Fn::GetAtt") & text), F.array(F.substring_index("sval", ".", 1)))
        targets = targets.when(dep, F.array("sval"))
        if include_sub:
            tokens = F.regexp_extract_all("sval", F.lit(r"\$\{([A-Za-z0-9:._-]+)\}"), F.lit(1))
            targets = targets.when(under & text & (prop.endswith("Fn::Sub") | prop.endswith("Fn::Sub/*")), F.transform(tokens, lambda t: F.substring_index(t, ".", 1)))
        all_ = self.props.select("template_id", F.col("logical_id").alias("src"), F.explode(targets).alias("dst"), F.coalesce(dep, F.lit(False)).cast("int").alias("late"), "ord")
        known = self.resources.select("template_id", F.col("logical_id").alias("dst"))
        ends = all_.where("src != dst").groupBy("template_id", "src", "dst").agg(F.min(F.struct("late", "ord")).alias("first")).join(known, ["template_id", "dst"], "left_semi")
        return ends.select("template_id", "src", "dst", *(["first.late", "first.ord"] if with_order else []))
