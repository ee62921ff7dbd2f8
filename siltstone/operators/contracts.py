"""Configuration trees: flattening, differences, fingerprints, key scans, closed forms."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from json.encoder import encode_basestring
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# Parts of a key that mark a credential, and starts of private paths.
CREDENTIAL_PARTS = ["api_key", "apikey", "password", "secret", "token_value", "access_token", "private_key", "credential"]
PRIVATE = ("home/", "root/", "users/", "c:/")
#: Keys of a block of neighbours(), as bits.
BLOCK_BITS = 10
#: Texts around numbers, numbers, and pairs of such texts that _Reader keeps; others are worked out each time.
SHAPES, NUMBERS, PAIRS = 4096, 65_536, 16_384
# What may be a JSON number, all between a colon, comma, bracket or blank and a comma, bracket or blank; it begins with the characters so that others are passed over fast.
_NUMBER = re.compile(r"([-0-9](?<=[:,\[\s][-0-9])[-+.0-9eE]*)(?=[,\]}\s])")


def _value(leaf: Any) -> str:
    """A leaf as JSON; those of a parsed document without a new encoder each."""
    kind = type(leaf)
    if kind is str:
        return encode_basestring(leaf)
    if kind is int or kind is float and math.isfinite(leaf):
        return repr(leaf)
    if leaf is None:
        return "null"
    if kind is bool:
        return "true" if leaf else "false"
    return json.dumps(leaf, sort_keys=True, ensure_ascii=False)


def _collect(tree: Any, prefix: str, out: list[tuple[str, str, str]]) -> None:
    if isinstance(tree, dict) and tree:
        for k, v in tree.items():
            _collect(v, f"{prefix}.{k}" if prefix else str(k), out)
    elif isinstance(tree, list) and tree:
        for i, v in enumerate(tree):
            _collect(v, f"{prefix}[{i}]", out)
    else:
        out.append((prefix, _value(tree), type(tree).__name__))


def flatten(tree: Any, prefix: str = "") -> list[tuple[str, str, str]]:
    """(path, value as JSON, type) of every leaf; list items are [i]; empty containers are leaves."""
    out: list[tuple[str, str, str]] = []
    _collect(tree, prefix, out)
    return out


def tree_table(spark: SparkSession, tree: Any) -> DataFrame:
    return spark.createDataFrame(flatten(tree), "path string, value string, type string")


def flat_table(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value, type) of every leaf of each row's JSON document; null documents, and texts that are no strict JSON, give no rows."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                try:
                    leaves = flatten(strict_json(text)) if text is not None else []
                except ValueError:
                    leaves = []
                at += [i] * len(leaves)
                out += leaves
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.string()) for c in cols]], names=[key, "path", "value", "type"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(document).cast("string")).mapInArrow(run, f"`{key}` {kind}, path string, value string, type string")


def lookup(document: Column, path: str) -> Column:
    """Text of the value at a dotted path of a JSON document; null where a key is missing or its parent is no object."""
    return F.get_json_object(document, "$." + path)


def load_document(text: str, yaml: bool = False) -> Any:
    """A configuration from JSON, or from YAML where a parser is installed; repeated keys are an error in both."""
    if not yaml:
        return strict_json(text)
    try:
        import yaml as parser
    except ImportError as e:
        raise RuntimeError("no YAML parser is installed") from e

    class Loader(parser.SafeLoader):
        pass

    def mapping(loader, node):
        out = {}
        for k, v in loader.construct_pairs(node, deep=True):
            if k in out:
                raise ValueError(f"the key {k!r} is repeated")
            out[k] = v
        return out

    Loader.add_constructor(parser.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return parser.load(text, Loader)


def canonical(tree: Any) -> str:
    return json.dumps(tree, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(tree: Any, without: tuple[str, ...] = ()) -> str:
    """SHA-256 of the canonical JSON, with dotted paths left out."""
    tree = json.loads(canonical(tree))
    for path in without:
        at, *rest = path.split(".")
        node, key = tree, at
        for part in rest:
            if not isinstance(node, dict) or key not in node:
                break
            node, key = node[key], part
        if isinstance(node, dict):
            node.pop(key, None)
    return hashlib.sha256(canonical(tree).encode()).hexdigest()


def _unique(items: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(items)
    if len(out) != len(items):
        raise ValueError("a key is repeated")
    return out


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


_STRICT = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_constant)


def strict_json(text: str) -> Any:
    """JSON without repeated keys or NaN and infinity constants."""
    return _STRICT.decode(text)


def difference(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, path, left_value, right_value) where value or type differs between two flattened trees (1, 1.0 and true are three values)."""
    on = [*(by or []), "path"]
    x = a.select(*on, F.struct("value", "type").alias("left"))
    y = b.select(*on, F.struct("value", "type").alias("right"))
    j = x.join(y, on, "full").where(~F.col("left").eqNullSafe(F.col("right")))
    return j.select(*on, F.col("left.value").alias("left_value"), F.col("right.value").alias("right_value"))


def held_constant(a: DataFrame, b: DataFrame, paths: list[str], by: str | None = None) -> DataFrame:
    """(by, path, held) of paths that must be there and equal, value and type, on both sides."""
    on = [*([by] if by else []), "path"]
    want = F.broadcast(a.sparkSession.createDataFrame([(p,) for p in paths], "path string"))
    every = a.select(by).union(b.select(by)).distinct().join(want) if by else want
    l, r = a.select(*on, F.struct("value", "type").alias("l")), b.select(*on, F.struct("value", "type").alias("r"))
    x = every.join(l, on, "left").join(r, on, "left")
    return x.select(*on, (F.col("l").isNotNull() & F.col("l").eqNullSafe(F.col("r"))).alias("held"))


def neighbours(rows: DataFrame, key: str) -> DataFrame:
    """rows as sorted blocks of 1024 keys, _block with them; the first key of a block also ends the block before, so a row and those of the following key share a block.

    Rows are shuffled once and nothing is broadcast; rows without a key have no neighbour and are dropped.
    """
    k = F.col(key)
    block = F.shiftright(k, BLOCK_BITS)
    posts = F.when(k.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0, F.array(block, block - 1)).otherwise(F.array(block))
    return rows.where(k.isNotNull()).withColumn("_block", F.explode(posts)).repartition("_block").sortWithinPartitions("_block", key)


def _by_path(tree: Any) -> dict[str, Any]:
    """{path: (value, type)} of a tree; a list of these under a path that two leaves share."""
    out: dict[str, Any] = {}
    for path, value, kind in flatten(tree):
        if path not in out:
            out[path] = (value, kind)
        elif isinstance(out[path], list):
            out[path].append((value, kind))
        else:
            out[path] = [out[path], (value, kind)]
    return out


class _Shape:
    """What documents share that differ in numbers alone: leaves by path, and the paths of the numbers."""

    def __init__(self, leaves: dict[str, Any], places: list[str]) -> None:
        self.leaves, self.places = leaves, places
        self.at = {p: i for i, p in enumerate(places)}


class _Document:
    """The leaves of one document: (value, type) by path, a list of these under a path that two leaves share.  With a shape, numbers has those at its places."""

    __slots__ = ("leaves", "numbers", "shape")

    def __init__(self, shape: _Shape | None, numbers: list[tuple[str, str]], leaves: dict[str, Any]) -> None:
        self.shape, self.numbers, self.leaves = shape, numbers, leaves

    def by_path(self) -> dict[str, Any]:
        return self.leaves | dict(zip(self.shape.places, self.numbers)) if self.shape else self.leaves

    def leaf(self, path: str) -> Any:
        i = self.shape.at.get(path) if self.shape else None
        return self.leaves.get(path) if i is None else self.numbers[i]


_EMPTY = _Document(None, [], {})


class _Reader:
    """Reads JSON documents, and compares two; null and what is no strict JSON have no leaves.

    Documents that differ in numbers alone have the same paths, so the text around the numbers is parsed once, with marks in the numbers' places.
    Where a mark doesn't come back as one leaf of its own (it stood in a string, or under a shared path), such documents are parsed each time.
    """

    def __init__(self) -> None:
        self.shapes: dict[tuple[str, ...], _Shape | None] = {}
        self.numbers: dict[str, tuple[str, str]] = {}
        self.pairs: dict[tuple[_Shape, _Shape], tuple | None] = {}

    def _shape(self, around: tuple[str, ...]) -> _Shape | None:
        marks = [str(10**30 + i) for i in range(len(around) - 1)]
        text = "".join(x for pair in zip(around, [*marks, ""]) for x in pair)
        try:
            found = _by_path(strict_json(text))
        except ValueError:
            return None
        at = {leaf: p for p, leaf in found.items() if isinstance(leaf, tuple)}
        places = [at.get((m, "int")) for m in marks]
        return None if None in places or any(text.count(m) > 1 for m in marks) else _Shape(found, places)

    def read(self, text: str | None) -> _Document:
        if text is None:
            return _EMPTY
        parts = _NUMBER.split(text)
        around = tuple(parts[::2])
        shape = self.shapes.get(around)
        if shape is None:
            if around not in self.shapes and len(self.shapes) < SHAPES:
                shape = self.shapes[around] = self._shape(around)
            if shape is None:
                try:
                    return _Document(None, [], _by_path(strict_json(text)))
                except ValueError:
                    return _EMPTY
        known = self.numbers
        try:
            numbers = [known.get(x) or self._number(x) for x in parts[1::2]]
        except ValueError:  # as 01, so the document is none
            return _EMPTY
        return _Document(shape, numbers, shape.leaves)

    def _number(self, text: str) -> tuple[str, str]:
        value = strict_json(text)
        leaf = (_value(value), type(value).__name__)
        if len(self.numbers) < NUMBERS:
            self.numbers[text] = leaf
        return leaf

    def _pair(self, s: _Shape, t: _Shape) -> tuple | None:
        """For two shapes: columns of what differs in any case, places of numbers on both sides, and paths with a number on one side; None if a shared path has one."""
        varying = s.at.keys() | t.at.keys()
        if any(type(x.leaves.get(p)) is list for x in (s, t) for p in varying):
            return None
        fixed: tuple[list, list, list] = ([], [], [])
        _changes(*({p: x for p, x in y.leaves.items() if p not in varying} for y in (s, t)), *fixed)
        both = [(p, i, t.at[p]) for p, i in s.at.items() if p in t.at]
        return fixed, both, [p for p in varying if (p in s.at) != (p in t.at)]

    def changes(self, a: _Document, b: _Document, paths: list[str], lefts: list[str | None], rights: list[str | None]) -> None:
        """Adds path, left value and right value of paths whose value or type differs."""
        plan, key = None, (a.shape, b.shape)
        if a.shape and b.shape:
            plan = self.pairs.get(key)
            if plan is None and key not in self.pairs and len(self.pairs) < PAIRS:
                plan = self.pairs[key] = self._pair(*key)
        if plan is None:
            _changes(a.by_path(), b.by_path(), paths, lefts, rights)
            return
        fixed, both, one = plan
        paths += fixed[0]
        lefts += fixed[1]
        rights += fixed[2]
        x, y = a.numbers, b.numbers
        for p, i, j in both:
            u, v = x[i], y[j]
            if u is not v and u != v:
                paths.append(p)
                lefts.append(u[0])
                rights.append(v[0])
        for p in one:
            u, v = a.leaf(p), b.leaf(p)
            if u != v:
                paths.append(p)
                lefts.append(u and u[0])
                rights.append(v and v[0])


def _matches(x: Any, y: Any) -> list[tuple[Any, Any]]:
    """What a full join on the path makes of the leaves of one path on both sides."""
    return [(u, v) for u in (x if isinstance(x, list) else [x]) for v in (y if isinstance(y, list) else [y])]


def _changes(a: dict[str, Any], b: dict[str, Any], paths: list[str], lefts: list[str | None], rights: list[str | None]) -> None:
    """Adds path, left value and right value of paths whose value or type differs."""
    shared = 0
    for p, x in a.items():
        y = b.get(p)
        if y is None:
            for u, _ in [x] if type(x) is tuple else x:
                paths.append(p)
                lefts.append(u)
                rights.append(None)
            continue
        shared += 1
        if type(x) is list or type(y) is list:
            for u, v in _matches(x, y):
                if u != v:
                    paths.append(p)
                    lefts.append(u[0])
                    rights.append(v[0])
        elif x != y:
            paths.append(p)
            lefts.append(x[0])
            rights.append(y[0])
    if shared < len(b):
        for p, y in b.items():
            if p not in a:
                for v, _ in [y] if type(y) is tuple else y:
                    paths.append(p)
                    lefts.append(None)
                    rights.append(v)


def _held(a: _Document, b: _Document, wanted: list[str], paths: list[str], held: list[bool]) -> None:
    for p in wanted:
        x, y = a.leaf(p), b.leaf(p)
        if type(x) is list or type(y) is list:
            for u, v in _matches(x, y):
                paths.append(p)
                held.append(u is not None and u == v)
        else:
            paths.append(p)
            held.append(x is not None and x == y)


def _compared(blocks: DataFrame, key: str, document: str, add: Callable[..., None], shape: str) -> DataFrame:
    """The rows that add(reader, left, right, *columns) appends for each configuration and each one of the following key, after the left key.

    blocks: neighbours() with documents.  Every document is read once, and only those of two keys are held.
    """
    ship(blocks.sparkSession)
    kind = blocks.schema[key].dataType.simpleString()
    fields = [x.split() for x in shape.split(", ")]
    types = [{"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}[t] for _, t in fields]
    names = [key, *[n for n, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = at = None
        before: list[_Document] = []
        now: list[_Document] = []
        reader = _Reader()
        for b in batches:
            keys, counts, columns = [], [], [[] for _ in types]
            for g, k, text in zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in b.columns]):
                if k != at or g != block:
                    before = now if g == block and k == at + 1 else []
                    block, at, now = g, k, []
                here = reader.read(text)
                now.append(here)
                for left in before:
                    add(reader, left, here, *columns)
                    keys.append(k - 1)
                    counts.append(len(columns[0]))
            every = np.repeat(np.array(keys, np.int64), np.diff(np.array(counts, np.int64), prepend=0))
            yield pa.RecordBatch.from_arrays([pa.array(every).cast(b.column(1).type), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return blocks.select("_block", key, F.col(document).cast("string")).mapInArrow(run, f"`{key}` {kind}, {shape}")


def neighbour_differences(blocks: DataFrame, key: str, document: str) -> DataFrame:
    """difference() of each configuration and the one of the following key: (key, path, left_value, right_value)."""
    return _compared(blocks, key, document, _Reader.changes, "path string, left_value string, right_value string")


def neighbour_held(blocks: DataFrame, key: str, document: str, paths: list[str]) -> DataFrame:
    """held_constant() of each configuration and the one of the following key: (key, path, held)."""
    return _compared(blocks, key, document, lambda _, a, b, *columns: _held(a, b, paths, *columns), "path string, held boolean")


def neighbour_ablation(blocks: DataFrame, key: str, document: str, changed: str, paths: list[str]) -> DataFrame:
    """validate.ablation() of each configuration and the one of the following key: (key, differing, only_changed, held, valid)."""

    def verdict(reader: _Reader, a: _Document, b: _Document, differing: list, only_changed: list, held: list, valid: list) -> None:
        found, equal = [], []
        reader.changes(a, b, found, [], [])
        _held(a, b, paths, [], equal)
        only, all_held = set(found) == {changed}, all(equal)
        differing.append(len(found))
        only_changed.append(only)
        held.append(all_held)
        valid.append(len(found) == 1 and only and all_held)

    return _compared(blocks, key, document, verdict, "differing bigint, only_changed boolean, held boolean, valid boolean")


def forbidden(flat: DataFrame, by: list[str] | None = None, prefixes: tuple[str, ...] = PRIVATE) -> DataFrame:
    """(by, path, violation): leaves under a key that looks like a credential's, inner keys included, and leaves of a path key whose value begins with a forbidden prefix.

    Keys are the steps of the path without list places; a path key ends in path or paths; values are compared in lower case, with slashes, without leading dots and slashes.
    """
    keys = F.split(F.lower(F.regexp_replace("path", "\\[\\d+\\]", "")), "\\.")
    bad = F.exists(keys, lambda k: k.rlike("|".join(CREDENTIAL_PARTS)))
    value = F.regexp_replace(F.lower(F.regexp_replace(F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v"), "\\\\", "/")), "^[./]+", "")
    private = F.lit(False)
    for p in prefixes:
        private = private | value.startswith(p) | (value == p.rstrip("/"))
    place = F.element_at(keys, -1).rlike("paths?$") & (F.col("type") == "str") & private
    return flat.select(*(by or []), "path", F.when(bad, "credential_key").when(place, "private_path").alias("violation")).where("violation is not null")


def parameter_count(vocabulary: int, context: int, width: int, layers: int, hidden: int, biased: bool = True, norms: bool = True, tied: bool = True, head_bias: bool = False) -> int:
    """Parameters of a decoder with learned positions: tables, four attention and two feed-forward matrices a block, two norms a block and one at the end."""
    matrices = 4 * width**2 + 2 * width * hidden
    offsets = 5 * width + hidden if biased else 0
    gains = 2 * width if norms else 0
    tables = (vocabulary * (1 if tied else 2) + context) * width + (vocabulary if head_bias else 0)
    return tables + layers * (matrices + offsets + 2 * gains) + gains


def cache_bytes(layers: int, heads: int, length: int, head_dim: int, item: int) -> int:
    return 2 * layers * heads * length * head_dim * item
