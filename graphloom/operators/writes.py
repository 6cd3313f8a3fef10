"""Writes: batches against a store, and the write requests of the template language.

``absent``, ``keyed`` and ``anchored`` plan bulk loads; ``appended`` writes one onto a store at rest. ``Session`` keeps a
store and applies write requests one by one; each appends one batch of numbered primitives.
"""

from __future__ import annotations

import resource
import threading
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import datatype_number, guid_number, guid_text, timestamp_number
from ..plans import reply
from ..plans.compiler import compile_read
from ..plans.errors import AlreadyThere, NotFound, RequestError, SemanticFault, Superseded, SyntaxFault, TooDear, TooMany
from ..plans.parser import parse
from ..plans.semantic import completed
from ..plans.tree import LINKAGES, Constraint, Request
from ..sources.primitives import FORMATS, SCHEMA, Store, dump, frame, restore, written
from ..sources.stored import Saved, save_more
from .verify import counts, verify


def absent(batch: DataFrame, existing: DataFrame, unique: list[str]) -> DataFrame:
    """Rows of ``batch`` whose ``unique`` fields no existing row has (null equals null)."""
    old = existing.select(*(F.col(c).alias(f"_{c}") for c in unique)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in unique]
    return batch.join(old, same, "left_anti")


def keyed(batch: DataFrame, existing: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
    """``batch`` with the id it meets by ``key`` (``old_id``) and what to do: insert, keep or version."""
    old = existing.select(F.col("id").alias("old_id"), *(F.col(c).alias(f"_{c}") for c in key + rest))
    joined = batch.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left")
    equal = F.lit(True)
    for c in rest:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(F.col("old_id").isNull(), "insert").when(equal, "keep").otherwise("version")
    return joined.withColumn("action", action).drop(*(f"_{c}" for c in key + rest))


def anchored(batch: DataFrame, existing: DataFrame, fields: list[str]) -> DataFrame:
    """``batch`` with the number of existing rows that each row must find exactly once (``found``)."""
    old = existing.groupBy(*(F.col(c).alias(f"_{c}") for c in fields)).agg(F.count("*").alias("_n"))
    joined = batch.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields], "left")
    return joined.withColumn("found", F.coalesce("_n", F.lit(0))).drop("_n", *(f"_{c}" for c in fields))


def numbered(batch: DataFrame, first: int, order: list[str]) -> DataFrame:
    """``batch`` with dense ids from ``first`` in ``order``: range partitions, then counts before each.

    The ranges are written once; dealt out anew they could fall otherwise.
    """
    ranged = batch.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.spark_partition_id()
    own = written(ranged.withColumns({"_part": place, "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # a row a partition
    before, total = {}, first
    for r in sorted(sizes, key=lambda r: r[0]):
        before[r[0]], total = total, total + r[1]
    if not before:
        return batch.withColumn("id", F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("_part").cast("long"))
    return own.withColumn("id", offset + F.col("_at")).drop("_part", "_at")


#: Subjects of a status; what has no counterpart in this engine is an empty list.
STATUS = ("connection", "database", "diary", "islink", "memory", "property", "replica", "rusage", "tiles")


def appended(saved: Saved, path: str, batch: DataFrame, key: list[str] | None = None, unique: list[str] | None = None, anchor: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Write a batch of primitives (without ids) onto the store at ``path``; the numbered rows, as a table at rest.

    The batch has the schema's columns but id, prev and lineage, which are made here. ``anchor``: fields
    by which each row must find exactly one live primitive that its ``left`` then is. ``unique``: no
    live primitive may have the same of these fields, nor two rows of the batch. ``key``: a row that
    finds a live primitive by these fields is left out if it says nothing new, and is its next version
    otherwise. Ends must be there already. All checks are joins over the batch; the first that fails
    ends the write with its code before anything is written.
    """
    live = saved.scan(None).filter("from_latest = 0 and live")
    rest = [f for f in ("typeguid", "right", "left", "scope", "name", "value", "valuetype", "archival") if f not in (key or [])]
    if anchor:
        held = live.groupBy(*(F.col(c).alias(f"_{c}") for c in anchor)).agg(F.count("*").alias("_n"), F.min("id").alias("_at"))
        batch = batch.join(held, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in anchor], "left")
        worst = batch.agg(F.min(F.coalesce("_n", F.lit(0))), F.max("_n")).collect()[0]
        if worst[0] == 0:
            raise NotFound("nothing matches what is anchored")
        if worst[1] is not None and worst[1] > 1:
            raise TooMany("several primitives match what is anchored")
        batch = batch.withColumn("left", F.col("_at")).drop("_n", "_at", *(f"_{c}" for c in anchor))
    ends = [batch.select(F.col(x).alias("id")) for x in LINKAGES]
    if saved.types:  # types that the store knows by name need no primitive
        ends = [e.filter(~F.col("id").isin(*saved.types.values())) if x == "typeguid" else e for x, e in zip(LINKAGES, ends)]
    asked = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).filter("id is not null").distinct()
    if asked.join(saved.primitives.select("id"), "id", "left_anti").limit(1).count():
        raise SemanticFault("an end of the batch is not there")
    if unique:
        if batch.groupBy(*unique).count().filter("count > 1").limit(1).count() or batch.count() > absent(batch, live, unique).count():
            raise AlreadyThere("a primitive with these unique fields is there already")
    if key:
        if batch.groupBy(*key).count().filter("count > 1").limit(1).count():
            raise SemanticFault("two rows of a batch have one key")
        old = live.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min_by(F.struct("id", "lineage", *rest), "id").alias("_old"))
        batch = batch.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left")
        same = F.lit(True)
        for c in rest:
            same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
        batch = batch.filter(F.col("_old").isNull() | ~same)
        batch = batch.withColumns({"prev": F.col("_old.id"), "lineage": F.col("_old.lineage")}).drop("_old", *(f"_{c}" for c in key))
    else:
        none = F.lit(None).cast("long")
        batch = batch.withColumns({"prev": none, "lineage": none})
    first = (saved.primitives.agg(F.max("id")).collect()[0][0] or -1) + 1
    names = [f.name for f in SCHEMA]
    rows = numbered(batch, first, order or [c for c in ("typeguid", "left", "right", "name", "value") if c in batch.columns])
    rows = written(rows.withColumn("lineage", F.coalesce("lineage", "id")).select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA)))
    save_more(rows, path, saved)
    return rows.select(*names)


@dataclass
class Session:
    """A store that requests read and change. Ids and timestamps are consecutive from 0."""

    spark: SparkSession
    rows: list[dict] = field(default_factory=list)  # what was written since the base
    types: dict[str, int] = field(default_factory=dict)
    base: DataFrame | None = None
    next_id: int = 0
    properties: dict[str, str] = field(default_factory=dict)

    def store(self) -> Store:
        new = frame(self.spark, self.rows)
        every = self.base.unionByName(new) if self.base is not None else new
        return Store(every, dict(self.types))

    def ask(self, text: str) -> str:
        try:
            request = parse(text)
            mark = f' id="{request.modifiers["id"]}"' if "id" in request.modifiers else ""
        except RequestError as e:
            return f'error {e.code} "{e}"'
        began = time.monotonic()
        try:
            reply.checked(request, self.next_id)
            body = getattr(self, f"on_{request.verb}")(request)
            return f"ok{reply.marks(request, self.next_id, began)} {body}".rstrip()
        except RequestError as e:
            return f'error {e.code}{mark} "{e}"'

    def on_read(self, request: Request) -> str:
        """``timeout`` (seconds) and ``cost`` (te or tr, milliseconds) cancel the jobs of the request; ``heatmap`` answers with the plan."""
        if "heatmap" in request.modifiers:
            compiler, root = compile_read(self.store(), request)
            return compiler.reply(root)._jdf.queryExecution().simpleString()
        costs = reply.allowed(request.modifiers.get("cost", ""))
        limits = [(n / 1000, TooDear("the request cost more than it may")) for x, n in costs.items() if x in ("te", "tr")]
        if "timeout" in request.modifiers:
            limits.append((float(request.modifiers["timeout"]), RequestError("timeout")))
        if not limits:
            return reply.read(self.store(), request)
        limit, fault = min(limits, key=lambda x: x[0])
        sc, group = self.spark.sparkContext, uuid.uuid4().hex
        sc.setJobGroup(group, "read", interruptOnCancel=True)
        alarm = threading.Timer(limit, sc.cancelJobGroup, [group])
        alarm.start()
        began = time.monotonic()
        try:
            body = reply.read(self.store(), request)
            if time.monotonic() - began > limit:  # done before the alarm could end a job
                raise fault
            return body
        except Py4JError as e:
            raise fault from e
        finally:
            alarm.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def on_write(self, request: Request) -> str:
        return self.write(request)

    def on_iterate(self, request: Request) -> str:
        """The number of candidates that the constraint's own conditions leave."""
        compiler, root = compile_read(self.store(), request)
        rows, _ = compiler.matches(root, frozenset(), False)
        return str(rows.count())

    def on_islink(self, request: Request) -> str:
        """Distinct left and right ends of the links that the constraint matches."""
        compiler, root = compile_read(self.store(), request)
        rows, _ = compiler.matches(root, frozenset(), False)
        found = rows.agg(F.countDistinct("left"), F.countDistinct("right")).collect()[0]
        return f"({found[0]} {found[1]})"

    def on_dump(self, request: Request) -> str:
        given = dict(a for a in request.arguments if isinstance(a, tuple))
        start, end = int(given.get("start", 0)), int(given.get("end", self.next_id))
        if "pagesize" in given:
            end = min(end, start + int(given["pagesize"]))
        records = dump(self.store().primitives, start, end)
        return f'("6" {start} {end} (' + " ".join(r[0] for r in records.orderBy("id").select("record").collect()) + "))"

    def on_restore(self, request: Request) -> str:
        """``("6" start end (record) ...)`` (or "1", "2", "5"); the records must go on where the store ends, or start at 0."""
        version, start, end, *records = request.arguments
        if version not in FORMATS:
            raise SemanticFault(f"can't restore version {version!r}")
        if len(records) == 1 and all(isinstance(r, list) for r in records[0]):
            records = records[0]
        if len(records) != int(end) - int(start):
            raise SemanticFault(f"expected {int(end) - int(start)} records, got {len(records)}")
        lines = [_record(r, (1, 2, 4) if FORMATS[version][0] else (2, 4)) for r in records]
        new = restore(self.spark.createDataFrame([(x,) for x in lines], "record string"), version=version) if lines else frame(self.spark, [])
        found = [r.asDict() for r in new.orderBy("id").collect()]
        if [r["id"] for r in found] != list(range(int(start), int(end))) or int(start) not in (0, self.next_id):
            raise SemanticFault("records don't follow one another")
        if int(start) == 0:
            self.base, self.rows, self.types = None, [], {}
        self.rows += found
        self.next_id = int(end)
        return ""

    def on_verify(self, request: Request) -> str:
        given = dict(a for a in request.arguments if isinstance(a, tuple))
        size = int(given.get("pagesize", 1000))
        faults = verify(self.store().primitives).orderBy("id", "fault").limit(size).collect()
        return "(" + " ".join(f'("{r.fault}" {guid_text(r.id)})' for r in faults) + ")"

    def on_status(self, request: Request) -> str:
        """A list for each subject that is asked for; without any, that of the database."""
        subjects = [x for x in request.arguments if isinstance(x, str)] or ["database"]
        parts = []
        for subject in subjects:
            if subject not in STATUS:
                raise SyntaxFault(f"no status of {subject!r}")
            pairs = getattr(self, f"_{subject}", dict)()
            parts.append("(" + " ".join(f'("{k}" {v})' for k, v in pairs.items()) + ")")
        return parts[0] if len(parts) == 1 else "(" + " ".join(parts) + ")"

    def _database(self) -> dict:
        return {k: v or 0 for k, v in counts(self.store().primitives).collect()[0].asDict().items()}

    def _connection(self) -> dict:
        return {"session": f'"{self.spark.sparkContext.applicationId}"'}

    def _property(self) -> dict:
        return {k: f'"{v}"' for k, v in sorted(self.properties.items())}

    def _memory(self) -> dict:
        heap = self.spark.sparkContext._jvm.Runtime.getRuntime()
        return {"used": heap.totalMemory() - heap.freeMemory(), "most": heap.maxMemory()}

    def _rusage(self) -> dict:
        used = resource.getrusage(resource.RUSAGE_SELF)
        return {"user": round(1000 * used.ru_utime), "system": round(1000 * used.ru_stime)}

    def on_set(self, request: Request) -> str:
        """Properties are Spark settings, or the session's own."""
        for item in request.arguments:
            if not isinstance(item, tuple):
                raise SemanticFault("set takes name=value")
            name, value = item
            if name.startswith("spark."):
                self.spark.conf.set(name, value)
            else:
                self.properties[name] = value
        return ""

    def on_sync(self, request: Request) -> str:
        return ""  # what a request wrote is there when it returns

    def load(self, records: list[str]) -> None:
        """Replace the store by dump records."""
        lines = self.spark.createDataFrame([(r,) for r in records], "record string")
        self.base, self.rows = restore(lines), []
        self.next_id = (self.base.agg(F.max("id")).collect()[0][0] or -1) + 1

    # --- write requests

    def write(self, request: Request) -> str:
        root = completed(request.root, "write")
        saved = (len(self.rows), dict(self.types), self.next_id)
        named = {guid_number(v) for c in _every(root) for p in c.predicates if p.name in LINKAGES or p.name == "guid" for v in p.values if v is not None}
        if missing := self.missing(named):
            raise SemanticFault(f"no primitive {', '.join(map(guid_text, sorted(missing)))}")
        try:
            plan: dict[int, int] = {}
            self.place(root, None, None, plan)
            return self.told(root, plan)
        except RequestError:
            del self.rows[saved[0] :]
            self.types, self.next_id = saved[1], saved[2]
            raise

    def missing(self, ids: set[int]) -> set[int]:
        """Those of the ids that no primitive has."""
        far = {n for n in ids if n >= self.next_id}
        near = sorted(ids - far)
        if not near or self.base is None:
            return far
        kept = {r["id"] for r in self.rows}
        asked = [n for n in near if n not in kept]
        return far | set(asked) - {r[0] for r in self.base.filter(F.col("id").isin(*asked)).select("id").collect()} if asked else far

    def told(self, c: Constraint, plan: dict[int, int]) -> str:
        parts = [guid_text(plan[id(c)]), *(self.told(x, plan) for x in c.children)]
        return "(" + " ".join(parts) + ")"

    def type_id(self, name: str, make: bool) -> int:
        if name not in self.types:
            if not make:
                return -1
            self.types[name] = self.append({"name": name}, None)
        return self.types[name]

    def append(self, fields: dict, old: dict | None) -> int:
        n = self.next_id
        self.next_id += 1
        extra = {"prev": old["id"], "lineage": old["lineage"]} if old else {}
        self.rows.append({"id": n} | extra | fields)
        return n

    def fields(self, c: Constraint) -> tuple[dict, tuple[str, int] | None]:
        out: dict = {}
        version = None
        for p in c.predicates:
            v = p.values[0]
            if p.name == "type":
                if v is not None:
                    out["typeguid"] = self.type_id(v, make=c.anchor is None)
            elif p.name == "guid":
                version = (p.op, guid_number(v))
            elif p.name in LINKAGES:
                out[p.name] = None if v is None else guid_number(v)
            elif p.name == "valuetype":
                out["valuetype"] = datatype_number(v)
            elif p.name == "timestamp":
                out["ts_raw"] = timestamp_number(v)
            elif p.name in ("name", "value"):
                if p.name in out:
                    raise SemanticFault(f"{p.name} is given twice")
                out[p.name] = v
        for name in ("live", "archival"):
            if c.flags.get(name) == "false":
                out[name] = False
        if version and version[0] == "=" and "live" in c.flags:
            out["live"] = c.flags["live"] != "false"
        return out, version

    def keyed_row(self, c: Constraint, own: dict) -> dict | None:
        """The row that a key's own fields name; ends that children state are not known yet."""
        names = ["typeguid" if k == "type" else k for k in c.key]
        if any(child.linkage == ("to", k) for child in c.children for k in names):
            return None
        found = self.found({k: own.get(k) for k in names})
        return found[0] if found else None

    def kept(self, c: Constraint, n: int | None) -> dict | None:
        """Row ``n``, if ``c`` (and all that it points to) states nothing else than what is there: a pointed cluster."""
        if n is None or c.key is not None or c.unique is not None or c.anchor is not None:
            return None
        rows = self.store().primitives.filter(F.col("id") == n).collect()
        own, version = self.fields(c)
        if not rows or version or not all(_same(rows[0][k], v) for k, v in own.items()):
            return None
        row = rows[0].asDict()
        outward = [x for x in c.children if x.linkage[0] == "to"]
        return row if all(self.kept(x, row[x.linkage[1]]) for x in outward) else None

    def place(self, c: Constraint, parent: int | None, back: str | None, plan: dict[int, int], held: dict | None = None) -> int:
        """Write what ``c`` points to, then ``c``, then what points to it; existing clusters are reused.

        held: the row that ``c`` is, where a keyed match points to it and nothing of it changes.
        """
        own, version = self.fields(c)
        if back:
            own[back] = parent
        held = self.keyed_row(c, own) if c.key is not None and c.anchor is None else held
        for child in c.children:
            if child.linkage[0] == "to":
                kept = self.kept(child, held[child.linkage[1]]) if held else None
                own[child.linkage[1]] = self.place(child, None, None, plan, kept)
        if held and c.key is None:  # what a keyed match points to, unchanged
            plan[id(c)] = n = held["id"]
        else:
            n = self.existing(c, own)
        if n is None:
            old = self.latest(*version) if version else None
            if c.unique is not None and self.found({"typeguid" if f == "type" else f: own.get("typeguid" if f == "type" else f) for f in c.unique}):
                raise AlreadyThere("a primitive with these unique fields is there already")
            n = self.append(own, old)
        plan[id(c)] = n
        for child in c.children:
            if child.linkage[0] == "from":
                self.place(child, n, child.linkage[1], plan)
        return n

    def existing(self, c: Constraint, own: dict) -> int | None:
        """The primitive that an anchor or a key stands for; a keyed one that differs gets a version."""
        if c.anchor in ("true", "local"):
            found = self.found(own)
            if not found:
                raise NotFound("nothing matches what is anchored")
            if len(found) > 1:
                raise TooMany("several primitives match what is anchored")
            return found[0]["id"]
        if c.key is None:
            return None
        names = ["typeguid" if k == "type" else k for k in c.key]
        found = self.found({k: own.get(k) for k in names})
        if not found:
            return None
        old = found[0]
        rest = [k for k in own if k not in names]
        if all(_same(old[k], own[k]) for k in rest):
            return old["id"]
        kept = {k: old[k] for k in ("typeguid", "right", "left", "scope", "name", "value", "valuetype", "archival")}
        return self.append(kept | own, old)

    def found(self, fields: dict) -> list[dict]:
        """Live latest primitives with these fields (texts compared as equality does)."""
        from ..functions.collate import compared

        df = self.store().scan(None).filter("from_latest = 0 and live")
        for k, v in fields.items():
            if v is None:
                df = df.filter(F.col(k).isNull())
            elif k in ("name", "value"):
                df = df.filter(compared(F.col(k), "=", v, "default"))
            else:
                df = df.filter(F.col(k) == v)
        return [r.asDict() for r in df.orderBy("id").limit(2).collect()]

    def latest(self, op: str, n: int) -> dict:
        """The version that a new one follows; ``=`` must name it itself."""
        store = self.store()
        line = store.primitives.filter(F.col("id") == n).select("lineage")
        rows = store.primitives.join(line, "lineage", "left_semi").orderBy(F.desc("id")).limit(1).collect()
        if not rows:
            raise NotFound(f"no primitive {guid_text(n)}")
        if op == "=" and rows[0]["id"] != n:
            raise Superseded("primitive is not the newest version")
        return rows[0].asDict()


def _every(c: Constraint) -> list[Constraint]:
    return [c, *(y for x in c.children for y in _every(x))]


def _record(fields: list, texts: tuple[int, ...]) -> str:
    """A parsed record as the line it came from; ``texts``: which fields are quoted."""
    quote = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return "(" + " ".join("null" if f is None else quote(f) if i in texts else f for i, f in enumerate(fields)) + ")"


def _same(a, b) -> bool:
    if isinstance(a, str) and isinstance(b, str):
        return " ".join(a.lower().split()) == " ".join(b.lower().split())
    return a == b
