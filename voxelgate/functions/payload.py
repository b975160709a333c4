"""Boxes from free-form JSON, as expressions on VARIANT values.

Two readings differ in which keys they try and in what a bad value means: "core" stops at the
first key that is there, "message" goes on to the next. A vector is a struct (ok, x, y, z); ok is
false where the entry has to be skipped or reported. What is used more than once is bound to a
lambda's variable, and what is read in the same way from several keys is an array with one lambda
over it, so that plans stay small and each value is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import quaternion_yaw

#: Keys of the two readings, in the order in which they are tried. Fixed values.
LIST_KEYS = {"core": ("objects", "detections", "boxes"), "message": ("objects", "detections", "boxes", "targets", "results")}
SIZE_KEYS = ("size", "dimensions", "extent", "bbox", "box")
SIDE_KEYS = (("length", "width", "height"), ("l", "w", "h"))
MESSAGE_SIZE_KEYS = ("size", "dimensions", "extent", "scale", "lwh", "shape")
FRAME_KEYS = ("bbox", "box", "bounding_box")
LABEL_KEYS = ("label", "name", "class_name", "class_id", "object_type", "type")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def get(v: Column, path: str) -> Column:
    """The value at a path; a JSON null is a value, a missing key is NULL."""
    return F.try_variant_get(v, f"$.{path}", "variant")


def item(v: Column, i: int) -> Column:
    """An item of a list; NULL for what is no list or too short."""
    return F.try_variant_get(v, f"$[{i}]", "variant")


def has(v: Column, *keys: str) -> Column:
    out = get(v, keys[0]).isNotNull()
    for k in keys[1:]:
        out = out & get(v, k).isNotNull()
    return out


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def number(v: Column) -> Column:
    """As a number, from a number or the text of one; else NULL. A boolean is no number."""
    return F.when(_kind(v) != "BOOLEAN", F.try_variant_get(v, "$", "double"))


def numbers(*values: Column) -> Column:
    return F.transform(F.array(*values), number)


def _vector(parts: Column) -> Column:
    """Of an array of three numbers, or NULL."""
    return bound(parts, lambda t: F.struct(F.coalesce(t[0].isNotNull() & t[1].isNotNull() & t[2].isNotNull(), F.lit(False)).alias("ok"), t[0].alias("x"), t[1].alias("y"), t[2].alias("z")))


def vector(v: Column) -> Column:
    """From an object with x, y, z or a list of three numbers."""
    listed = F.when(item(v, 2).isNotNull() & item(v, 3).isNull(), F.array(*[item(v, i) for i in range(3)]))
    return _vector(F.transform(F.coalesce(F.when(has(v, "x", "y", "z"), F.array(*[get(v, a) for a in "xyz"])), listed), number))


def _positive(s: Column) -> Column:
    return s["ok"] & (s["x"] > 0) & (s["y"] > 0) & (s["z"] > 0)


def _vectors(*values: Column) -> Column:
    """The vectors of those values that are there."""
    return F.transform(F.filter(F.array(*values), lambda v: v.isNotNull()), vector)


def _triples(e: Column) -> Column:
    """The vectors of sides that an entry has all keys of."""
    found = F.filter(F.array(*[F.when(has(e, *keys), F.array(*[get(e, k) for k in keys])) for keys in SIDE_KEYS]), lambda t: t.isNotNull())
    return F.transform(found, lambda t: _vector(F.transform(t, number)))


def _first(vectors: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.coalesce(F.get(vectors, F.lit(0)), F.struct(F.lit(False).alias("ok"), none.alias("x"), none.alias("y"), none.alias("z")))


def center(e: Column) -> Column:
    return vector(F.when(has(e, "center"), get(e, "center")).when(has(e, "x", "y", "z"), e).when(has(e, "position"), get(e, "position")).otherwise(get(e, "pose.position")))


def size(e: Column) -> Column:
    """The first vector of positive sides. A vector that can't be read ends the search; one that isn't positive doesn't."""
    named = F.filter(_vectors(*[get(e, k) for k in SIZE_KEYS]), lambda s: ~s["ok"] | _positive(s))
    return _first(F.concat(named, _triples(e), _vectors(F.when(has(e, "shape") & has(get(e, "shape"), "x", "y", "z"), get(e, "shape")))))


def _turn(v: Column, strict: bool) -> Column:
    """Yaw of a quaternion: an object x, y, z, w or, where not strict, with parts left out or as a list of four; else NULL."""
    rest = {"x": 0.0, "y": 0.0, "z": 0.0, "w": None if strict else 1.0}
    part = lambda value, other: F.struct(value.alias("v"), F.lit(other).cast("double").alias("other"))
    parts = F.when(is_object(v), F.array(*[part(get(v, k), None if strict else d) for k, d in rest.items()]))
    if not strict:
        parts = parts.when(item(v, 3).isNotNull() & item(v, 4).isNull(), F.array(*[part(item(v, i), None) for i in range(4)]))
    read = F.transform(parts, lambda p: F.when(p["v"].isNull(), p["other"]).otherwise(number(p["v"])))
    return bound(read, lambda t: quaternion_yaw(t[3], t[0], t[1], t[2]))


def yaw(e: Column) -> Column:
    """NULL where the value that counts can't be read."""
    rotation = get(e, "rotation")
    read = numbers(*[get(e, k) for k in ("yaw", "yaw_deg", "heading", "rotation.yaw", "rotation.z")], item(rotation, 2), item(get(e, "rpy"), 2))

    def pick(t: Column) -> Column:
        out = F.when(has(e, "yaw"), t[0]).when(has(e, "yaw_deg"), F.radians(t[1])).when(has(e, "heading"), t[2]).when(has(e, "orientation"), _turn(get(e, "orientation"), False))
        out = out.when(has(e, "rotation.yaw"), t[3]).when(has(e, "rotation.z"), t[4])
        short = F.when(item(rotation, 2).isNotNull(), t[5]).otherwise(F.lit(0.0))
        return out.when(_kind(rotation).startswith("ARRAY"), short).when(item(get(e, "rpy"), 2).isNotNull(), t[6]).otherwise(F.lit(0.0))

    return bound(read, pick)


def text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _first_key(v: Column, *keys: str) -> Column:
    """The value of the first key that is there, whatever it is."""
    return F.coalesce(*[get(v, k) for k in keys])


def _place(v: Column) -> Column:
    """A centre, or the position within it."""
    return bound(_first_key(v, "center", "position"), lambda c: F.coalesce(get(c, "position"), c))


def message_center(e: Column) -> Column:
    inner = bound(_first_key(e, *FRAME_KEYS), lambda box: F.coalesce(_place(box), get(box, "pose.position")))
    return _first(F.filter(_vectors(_place(e), inner, F.when(has(e, "x", "y", "z"), e), get(e, "pose.position")), lambda c: c["ok"]))


def message_size(e: Column) -> Column:
    inner = bound(_first_key(e, *FRAME_KEYS), lambda box: _first_key(box, *MESSAGE_SIZE_KEYS))
    named = F.filter(_vectors(*[get(e, k) for k in MESSAGE_SIZE_KEYS], inner), _positive)
    return _first(F.concat(named, F.filter(_triples(e), lambda s: s["ok"])))


def message_yaw(e: Column) -> Column:
    read = numbers(_first_key(e, "yaw", "heading"), _first_key(e, "yaw_deg", "heading_deg"), item(get(e, "rpy"), 2))
    inner = bound(_first_key(e, *FRAME_KEYS), lambda box: F.array(_first_key(box, "orientation", "rotation"), get(box, "pose.orientation")))
    turns = F.transform(F.concat(F.array(_first_key(e, "orientation", "rotation"), get(e, "pose.orientation")), inner), lambda q: _turn(q, True))
    return bound(F.struct(read.alias("n"), F.filter(turns, lambda q: q.isNotNull()).alias("q")), lambda r: F.coalesce(r["n"][0], F.radians(r["n"][1]), F.get(r["q"], F.lit(0)), r["n"][2]))


def seconds(v: Column) -> Column:
    """A stamp as seconds: a number, or an object with sec and nanosec, or secs and nsecs."""
    parts = lambda s, n: F.when(has(v, s), number(get(v, s)) + F.when(has(v, n), number(get(v, n))).otherwise(F.lit(0.0)) * 1e-9)
    plain = F.when(_kind(v).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double")).when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
    return F.coalesce(plain, parts("sec", "nanosec"), parts("secs", "nsecs"))


def message_stamp(v: Column) -> Column:
    """The first stamp of the message, its header or its msg_header, else time or timestamp; a stamp of 0 counts as none."""
    found = F.transform(F.array(get(v, "stamp"), get(v, "header.stamp"), get(v, "msg_header.stamp"), _first_key(v, "stamp", "time", "timestamp")), seconds)
    return bound(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), lambda x: F.when(x != 0, x))


def entries(v: Column, reading: str = "core") -> Column:
    """The box entries of a payload, as an array of VARIANT; NULL for a payload that is neither list nor object."""
    lists = F.transform(F.array(v, *[get(v, k) for k in LIST_KEYS[reading]]), lambda x: F.try_variant_get(x, "$", "array<variant>"))
    return F.coalesce(F.get(F.filter(lists, lambda x: x.isNotNull()), F.lit(0)), F.when(is_object(v), F.array(v)))


def document(json_text: Column) -> Column:
    """A JSON text as VARIANT; text within text is read too."""
    return bound(F.try_parse_json(json_text), lambda v: F.when(_kind(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v))


_READINGS: dict[str, Callable[[Column], tuple[Column, Column, Column, Column]]] = {}


def reading(name: str):
    """Registers how an entry becomes center, size, yaw and label; payload classes are known by name only."""

    def put(f):
        _READINGS[name] = f
        return f

    return put


@reading("core")
def _core(e: Column) -> tuple[Column, Column, Column, Column]:
    return center(e), size(e), yaw(e), text(get(e, "label"))


@reading("message")
def _message(e: Column) -> tuple[Column, Column, Column, Column]:
    # what the message's own keys give is a default for the core keys, which are read as ever
    c = F.when(has(e, "center"), vector(get(e, "center"))).otherwise(message_center(e))
    own = F.when(~has(e, "size"), message_size(e))
    s = bound(own, lambda s: F.when(~s["ok"] | _positive(s), s).otherwise(size(e)))
    y = F.when(has(e, "yaw"), number(get(e, "yaw"))).otherwise(F.coalesce(message_yaw(e), yaw(e)))
    return c, s, y, F.when(has(e, "label"), text(get(e, "label"))).otherwise(text(_first_key(e, *LABEL_KEYS)))


def read_entry(e: Column, name: str) -> Column:
    """An entry in the reading of that name: struct ok, cx..h, yaw, label. What is no object has no center, so it isn't ok."""
    c, s, y, label = _READINGS[name](e)
    sides = lambda r: [r["c"][a].alias(f"c{a}") for a in "xyz"] + [r["s"][a].alias(b) for a, b in zip("xyz", "lwh", strict=True)]
    ok = lambda r: F.coalesce(r["c"]["ok"] & r["s"]["ok"] & r["y"].isNotNull(), F.lit(False))
    return bound(F.struct(c.alias("c"), s.alias("s"), y.alias("y"), label.alias("label")), lambda r: F.struct(ok(r).alias("ok"), *sides(r), r["y"].alias("yaw"), r["label"].alias("label")))


#: Bytes of payloads that a task can read without being one of few: a payload's rows cost far more than its bytes.
_TASK_BYTES = 4 << 20


def _dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores where they are so few bytes that one or two tasks would read them all.

    What is shuffled for it is at most _TASK_BYTES a core; larger tables and streams are left as they are split.
    """
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size <= cores * _TASK_BYTES else rows


def parse_boxes(rows: DataFrame, payload: str, name: str = "core", skip_invalid: bool = True) -> DataFrame:
    """rows with a JSON column to one row for each box: the other columns, box_id (place in the payload), cx..h, yaw, label.

    Entries that can't be read are left out, or are an error if not skip_invalid.
    """
    others = [c for c in rows.columns if c != payload]

    def boxes(v: Column) -> Column:
        listed = entries(v, name)
        if not skip_invalid:
            listed = F.coalesce(listed, F.raise_error(F.lit("no list of boxes in this payload")).cast("array<variant>"))
        read = F.transform(listed, lambda e, i: F.struct(i.cast("long").alias("box_id"), read_entry(e, name).alias("b"), *([] if skip_invalid else [F.to_json(e).alias("text")])))
        if skip_invalid:
            return F.filter(read, lambda r: r["b"]["ok"])
        return F.filter(read, lambda r: F.when(r["b"]["ok"], F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("this entry is no box: "), r["text"])).cast("boolean")))

    out = _dealt(rows).select(*others, F.explode(bound(document(F.col(payload)), boxes)).alias("_r"))
    return out.select(*others, "_r.box_id", *[f"_r.b.{c}" for c in ("cx", "cy", "cz", "l", "w", "h", "yaw", "label")])
