"""The engine: declared sources, continuous queries and views over them, and ad-hoc SQL.

Objects are session views: a source is the rows inserted or its connector's, a
stream or view is its query over them, so every read sees the newest snapshot and
Catalyst plans through all layers. ``start`` runs a stream as a Structured Streaming
query where its sources are streaming.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eddyflow.catalog import Catalog, Object
from eddyflow.errors import CatalogError, SqlError, StreamError
from eddyflow.functions import scalar
from eddyflow.operators import changelog
from eddyflow.operators.windows import in_micros, micros
from eddyflow.sources import connectors
from eddyflow.sources.schema import type_of
from eddyflow.sql import lex, rewrite
from eddyflow.streaming import run as streaming
from eddyflow.streaming.views import Subscription, View

ORDER = "__arrival"
LINEAGE = 32  # inserts after which a source's rows are cut from those that made them
SKEW = 300  # seconds that an event may be ahead of the clock and still move the watermark


class Engine:
    """One catalog over a Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog()
        self.data: dict[str, DataFrame] = {}
        self.arrivals: dict[str, int] = {}
        self.watermarks: dict[str, int] = {}
        self.touched: dict[str, float] = {}
        self.running: dict[str, object] = {}
        self.views: dict[str, View] = {}
        self.cursors: dict[str, Subscription] = {}
        self.settings: dict[str, str] = {}
        self.metrics: dict[str, dict] = {}
        scalar.register(spark)

    # ------------------------------------------------------------ statements
    def execute(self, sql: str, variables: dict[str, str] | None = None) -> DataFrame | str | list[Row] | None:
        """Run statements; the result of the last one. ``${NAME}`` is filled from ``variables``."""
        for k, v in (variables or {}).items():
            sql = sql.replace("${" + k + "}", v)
        out = None
        for text in lex.statements(sql):
            out = self._one(text)
        return out

    def sql(self, query: str) -> DataFrame:
        """An ad-hoc query over the current snapshot."""
        return self._select(query)

    def _one(self, text: str):
        ts = lex.tokens(text)
        head = [t.upper for t in ts[:6]]
        at = lambda *w: head[: len(w)] == list(w)
        if at("CREATE"):
            return self._create(text, ts)
        if at("DROP"):
            return self._drop(text, ts)
        if at("ALTER", "SOURCE"):
            return self._alter(text, ts)
        if at("INSERT", "INTO"):
            return self._insert(text, ts)
        if at("SHOW"):
            return self._show(text, ts)
        if at("DESCRIBE") or at("DESC"):
            return self._describe(lex.name_of(ts[2 if head[1] == "EXTENDED" else 1].text))
        if at("EXPLAIN"):
            return self._explain(text, ts)
        if at("SUBSCRIBE"):
            return self._subscribe(text, ts)
        if at("DECLARE"):
            i = lex.find(ts, "SUBSCRIBE")
            self.cursors[lex.name_of(ts[1].text)] = self._subscribe(text[ts[i].start :], ts[i:])
            return "DECLARE"
        if at("FETCH"):
            cursor = self._cursor(lex.name_of(ts[-1].text))
            if any(t.upper == "ALL" for t in ts[1:3]):
                return cursor.frame()
            return cursor.fetch(next((int(t.text) for t in ts if t.kind == "number"), 1))
        if at("CLOSE"):
            self._cursor(lex.name_of(ts[1].text)).close()
            del self.cursors[lex.name_of(ts[1].text)]
            return "CLOSE"
        if at("SET"):
            m = re.match(r"(?is)SET\s+([\w.]+)\s*(?:=|TO)\s*(.+)$", text)
            if not m:
                raise SqlError(f"cannot read {text!r}")
            self.settings[m[1].lower()] = lex.literal(m[2].strip())
            return "SET"
        if at("CHECKPOINT"):
            return self.checkpoint()
        if at("RESTORE"):
            raise StreamError("queries resume from their checkpoint when they start; there is nothing to restore")
        return self._select(text)

    def _cursor(self, name: str) -> Subscription:
        if name not in self.cursors:
            raise CatalogError(f"no cursor {name!r}")
        return self.cursors[name]

    # ------------------------------------------------------------ create
    def _create(self, text: str, ts: list[lex.Token]):
        i, replace = 1, False
        if ts[1].upper == "OR":
            i, replace = 3, True
        words = [t.upper for t in ts[i : i + 3]]
        kinds = {("MATERIALIZED", "VIEW"): "view", ("CONTINUOUS", "QUERY"): "stream", ("LOOKUP", "TABLE"): "lookup", ("SOURCE",): "source", ("SINK",): "sink", ("STREAM",): "stream", ("TABLE",): "table"}
        for w, kind in kinds.items():
            if tuple(words[: len(w)]) == w:
                i += len(w)
                break
        else:
            raise SqlError(f"cannot create {' '.join(words)}")
        if_not = ts[i].upper == "IF"
        i += 3 * if_not
        name = lex.name_of(ts[i].text)
        if name in self.catalog.objects and if_not:
            return f"{name} exists"
        x = {"stream": self._query_object, "view": self._query_object, "sink": self._sink_object}.get(kind, self._table_object)(kind, name, text, ts, i + 1)
        self.catalog.add(x, replace=replace)
        self._publish(x)
        return f"CREATE {x.kind} {name}"

    def _table_object(self, kind: str, name: str, text: str, ts: list[lex.Token], i: int) -> Object:
        x = Object(kind, name, text)
        if i < len(ts) and ts[i].upper == "AS":
            x.sql = text[ts[i].end :].strip()
            return x
        if i < len(ts) and ts[i].text == "(":
            parts, j = lex.arguments(text, ts, i)
            for p in parts:
                if m := re.match(r"(?is)WATERMARK\s+FOR\s+([\w\"]+)(?:\s+AS\s+(.+))?$", p):
                    col, expr = lex.name_of(m[1]), (m[2] or "").strip()
                    if re.fullmatch(r"(?i)PROCTIME\s*\(\s*\)", expr):
                        continue
                    lag = re.search(r"(?is)-\s*(INTERVAL.+)$", expr)
                    x.watermark = (col, rewrite.duration(lag[1]) if lag else 0 if not expr or expr == col else 1_000_000)
                elif m := re.match(r"(?is)PRIMARY\s+KEY\s*\((.+)\)$", p):
                    x.keys = [lex.name_of(k.strip()) for k in m[1].split(",")]
                elif p == "*" or p.startswith("* "):
                    continue
                else:
                    col, _, kind_ = p.partition(" ")
                    if re.search(r"(?i)\bPRIMARY\s+KEY\b", kind_):
                        x.keys = [lex.name_of(col)]
                    kind_ = re.sub(r"(?i)\b(NOT\s+NULL|NULL|PRIMARY\s+KEY|DEFAULT\s+.*)\b", "", kind_).strip()
                    x.columns.append((lex.name_of(col), type_of(kind_)))
            i = j + 1
        while i < len(ts):
            word = ts[i].upper
            if word == "FROM":
                x.connector = ts[i + 1].text.lower()
                i += 2
                if i < len(ts) and ts[i].text == "(":
                    parts, j = lex.arguments(text, ts, i)
                    x.options |= rewrite.options(parts)
                    i = j + 1
            elif word == "FORMAT":
                x.options["format"] = ts[i + 1].text.lower()
                i += 2
            elif word == "WITH" and ts[i + 1].text == "(":
                parts, j = lex.arguments(text, ts, i + 1)
                x.options |= rewrite.options(parts)
                i = j + 1
            elif word == "ALLOW" and ts[i + 1].upper == "LATENESS":
                x.lateness_us = rewrite.duration(text[ts[i + 2].start : ts[min(i + 4, len(ts) - 1)].end])
                i += 5
            else:
                raise SqlError(f"cannot read {text[ts[i].start :]!r}")
        x.connector = x.connector or x.options.pop("connector", None)
        if x.watermark and x.columns and x.watermark[0] not in dict(x.columns):
            raise SqlError(f"the watermark's column {x.watermark[0]!r} is not declared")
        return x

    def _query_object(self, kind: str, name: str, text: str, ts: list[lex.Token], i: int) -> Object:
        if ts[i].upper != "AS":
            raise SqlError(f"CREATE {kind.upper()} needs AS")
        body, options = rewrite.split_with(text[ts[i].end :].strip())
        q = rewrite.split_emit(body)
        if kind == "stream":
            rewrite.streaming_rejections(q.sql)
        used = {lex.name_of(t.text) for t in lex.tokens(q.sql) if t.kind in ("word", "name")}
        return Object(kind, name, text, sql=body, emit=q.emit, options=options, inputs=[n for n in self.catalog.objects if n in used and n != name])

    def _sink_object(self, kind: str, name: str, text: str, ts: list[lex.Token], i: int) -> Object:
        m = re.match(r"(?is)\s*FROM\s+(\w+)(?:\s+WHERE\s+(.+?))?(?:\s+INTO\s+(\w+)\s*(?:\((.*?)\))?)?(?:\s+FORMAT\s+(\w+))?(?:\s+WITH\s*\((.*)\))?\s*$", text[ts[i - 1].end :])
        if not m:
            raise SqlError(f"cannot read {text!r}")
        self.catalog.get(m[1])
        x = Object("sink", name, text, inputs=[m[1]], where=m[2], connector=(m[3] or "memory").lower())
        for part in (m[4], m[6]):
            if part:
                x.options |= rewrite.options(re.split(r",(?=(?:[^']*'[^']*')*[^']*$)", part))
        if m[5]:
            x.options["format"] = m[5].lower()
        return x

    # ------------------------------------------------------------ views of the session
    def _publish(self, x: Object) -> None:
        """Make an object readable by SQL, and what depends on it anew."""
        for name in [x.name, *self.catalog.downstream(x.name)]:
            y = self.catalog.objects[name]
            if y.kind == "sink":
                continue
            self._frame(y).createOrReplaceTempView(name)

    def _frame(self, x: Object) -> DataFrame:
        if x.kind in ("stream", "view") or x.sql:
            return self._select(x.sql, x)
        if x.connector and x.connector not in ("memory", "static"):
            schema = StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in x.columns)) if x.columns else None
            return connectors.source(self.spark, x.connector, schema, x.options)
        if x.name not in self.data:
            self.data[x.name] = self.spark.createDataFrame([], StructType.fromDDL(", ".join([*(f"`{c}` {t}" for c, t in x.columns), f"{ORDER} BIGINT"])))
        return self.data[x.name].drop(ORDER)

    def _select(self, text: str, x: Object | None = None) -> DataFrame:
        q = rewrite.split_emit(text)
        mark, late = None, 0
        if q.emit in ("on window close", "final"):
            sources = self._time_sources(q.sql)
            if not sources:
                raise StreamError(f"EMIT {q.emit.upper()} needs a source with a watermark")
            least = self.least_watermark([x.name for x in sources])
            mark, late = f"CAST(timestamp_micros({least}) AS TIMESTAMP_NTZ)", max(x.lateness_us for x in sources)
        done = rewrite.rewrite(self.spark, text, watermark=mark, lateness_us=late)
        return self.spark.sql(done.sql)

    def least_watermark(self, sources: list[str]) -> int:
        """What holds windows open: the slowest source that is not idle; if all are idle, the furthest.

        A source is idle if it has an ``idle_timeout`` and got no row for so long.
        """
        marks = {n: self.watermark(n) for n in sources}
        limit = {n: self.catalog.objects[n].options.get("idle_timeout") for n in sources}
        awake = [n for n in sources if limit[n] is None or time.time() - self.touched.get(n, 0.0) < micros(limit[n]) / 1e6]
        low = -(1 << 60)
        if awake:
            return min(low if marks[n] is None else marks[n] for n in awake)
        return max(low if m is None else m for m in marks.values())

    def _time_sources(self, sql: str) -> list[Object]:
        """All sources with a watermark that a query reads, itself or through streams."""
        used = {lex.name_of(t.text) for t in lex.tokens(sql) if t.kind in ("word", "name")} & set(self.catalog.objects)
        names = used | {m for k in used for m in self.catalog.upstream(k)}
        return [self.catalog.objects[n] for n in sorted(names) if self.catalog.objects[n].watermark]

    def watermark(self, source: str) -> int | None:
        """The source's event-time bound in microseconds: its last time less the delay, or what was set if later.

        Times too far ahead of the clock do not count.
        """
        x = self.catalog.get(source, "source")
        if not x.watermark:
            return None
        us = in_micros(F.col(x.watermark[0]))
        last = self.spark.table(source).agg(F.max(F.when(us <= (time.time() + SKEW) * 1e6, us))).first()[0]
        seen = [v for v in (None if last is None else last - x.watermark[1], self.watermarks.get(source)) if v is not None]
        return max(seen, default=None)

    def advance(self, source: str, us: int) -> None:
        """Set a source's watermark forward; it never goes back."""
        self.watermarks[source] = max(us, self.watermarks.get(source, us))
        self._publish(self.catalog.get(source, "source"))

    # ------------------------------------------------------------ rows
    def insert(self, name: str, rows: DataFrame | Iterable) -> int:
        """Push rows into a source or table. A table with a key takes them as upserts.

        Rows of a source that are older than its watermark, or have no time, are dropped.
        """
        x = self.catalog.get(name, "source", "table", "lookup")
        if x.connector and x.connector not in ("memory", "static"):
            raise CatalogError(f"{name} is fed by {x.connector}")
        schema = self._frame(x).schema
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), schema)
        df = df.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, schema.fields, strict=True)])
        stats = self.metrics.setdefault(name, {"rows": 0, "late": 0, "null_time": 0})
        if x.kind == "source" and x.watermark:
            bound, col = self.watermark(name), F.col(x.watermark[0])
            late = F.lit(False) if bound is None else in_micros(col) < bound
            n_late, n_null = df.agg(F.count(F.when(late, 1)), F.count(F.when(col.isNull(), 1))).first()
            stats["late"] += n_late
            stats["null_time"] += n_null
            df = df.filter(col.isNotNull() & ~late)
        n = df.count()
        stats["rows"] += n
        self.touched[name] = time.time()
        self.arrivals[name] = self.arrivals.get(name, 0) + 1
        new = df.withColumn(ORDER, F.lit(self.arrivals[name]).cast("long"))
        old = self.data[name]
        if x.keys and x.kind != "source":
            last = changelog.latest(new.withColumn("_i", F.monotonically_increasing_id()), x.keys, [F.desc("_i")]).drop("_i")
            self.data[name] = changelog.upsert_table(old, last, x.keys)
        else:
            self.data[name] = old.unionByName(new)
        if self.arrivals[name] % LINEAGE == 0 and self.spark.sparkContext.getCheckpointDir():
            self.data[name] = self.data[name].checkpoint()
        self._publish(x)
        return n

    def _insert(self, text: str, ts: list[lex.Token]) -> str:
        name, i = lex.name_of(ts[2].text), 3
        cols = None
        if ts[i].text == "(" and ts[i + 1].upper not in ("SELECT", "VALUES"):
            parts, j = lex.arguments(text, ts, i)
            cols, i = [lex.name_of(p) for p in parts], j + 1
        df = self.spark.sql(text[ts[i].start :]) if ts[i].upper == "VALUES" else self._select(text[ts[i].start :])
        schema = self._frame(self.catalog.get(name)).schema
        if cols:
            df = df.toDF(*cols).select(*[F.col(f.name) if f.name in cols else F.lit(None).alias(f.name) for f in schema.fields])
        return f"INSERT {self.insert(name, df)}"

    # ------------------------------------------------------------ drop, alter, show
    def _drop(self, text: str, ts: list[lex.Token]) -> str:
        words = [t.upper for t in ts]
        kinds = {"SOURCE": ("source",), "SINK": ("sink",), "STREAM": ("stream",), "VIEW": ("view",), "QUERY": ("stream",), "TABLE": ("table", "lookup")}
        k = next((w for w in words[1:3] if w in kinds), None)
        if k is None:
            raise SqlError(f"cannot read {text!r}")
        i = words.index(k) + 1
        missing = words[i] == "IF"
        name = lex.name_of(ts[i + 2 * missing].text)
        for gone in self.catalog.drop(name, *kinds[k], cascade=words[-1] == "CASCADE", missing_ok=missing):
            self.stop(gone)
            self.data.pop(gone, None)
            self.spark.catalog.dropTempView(gone)
        return f"DROP {name}"

    def _alter(self, text: str, ts: list[lex.Token]) -> str:
        x = self.catalog.get(lex.name_of(ts[2].text), "source")
        if ts[3].upper == "ADD":
            i = 5 if ts[4].upper == "COLUMN" else 4
            col, kind = lex.name_of(ts[i].text), type_of(text[ts[i + 1].start :].strip())
            if col in dict(x.columns):
                raise CatalogError(f"{x.name} has a column {col!r}")
            x.columns.append((col, kind))
            if x.name in self.data:
                self.data[x.name] = self.data[x.name].drop(ORDER).withColumn(col, F.lit(None).cast(kind)).withColumn(ORDER, F.lit(0).cast("long"))
        elif ts[3].upper == "SET":
            x.options |= rewrite.options(lex.arguments(text, ts, 4)[0])
        else:
            raise SqlError(f"cannot read {text!r}")
        self._publish(x)
        return f"ALTER {x.name}"

    def _rows(self, rows: list[tuple], ddl: str) -> DataFrame:
        return self.spark.createDataFrame(rows, ddl)

    def _show(self, text: str, ts: list[lex.Token]) -> DataFrame:
        what = " ".join(t.upper for t in ts[1:3])
        if what.startswith("CREATE"):
            return self._rows([(self.catalog.get(lex.name_of(ts[3].text), ts[2].text.lower()).ddl,)], "create_statement string")
        if what == "CHECKPOINT STATUS":
            return self._rows([(n, str(q.status["message"]), q.lastProgress["batchId"] if q.lastProgress else None) for n, q in self.running.items()], "name string, status string, epoch long")
        kinds = {"SOURCES": ("source",), "SINKS": ("sink",), "STREAMS": ("stream",), "QUERIES": ("stream", "view"), "MATERIALIZED VIEWS": ("view",), "TABLES": ("table", "lookup")}.get(what)
        if kinds is None:
            raise SqlError(f"cannot show {what}")
        rows = [(x.name, x.kind, x.connector, x.options.get("format"), x.watermark[0] if x.watermark else None, ",".join(x.inputs) or None, x.sql, x.emit) for x in self.catalog.of(*kinds)]
        return self._rows(rows, "name string, kind string, connector string, format string, watermark string, inputs string, sql string, emit string")

    def _describe(self, name: str) -> DataFrame:
        x = self.catalog.get(name)
        df = self.spark.table(name) if x.kind != "sink" else self.spark.table(x.inputs[0])
        return self._rows([(f.name, f.dataType.simpleString(), f.nullable, bool(x.watermark and x.watermark[0] == f.name), f.name in x.keys) for f in df.schema.fields], "column string, type string, nullable boolean, watermark boolean, key boolean")

    def _explain(self, text: str, ts: list[lex.Token]) -> DataFrame:
        analyze = ts[1].upper == "ANALYZE"
        df = self._select(text[ts[1 + analyze].start :])
        if analyze:
            began = time.monotonic()
            n = df.count()
            return self._rows([(n, int((time.monotonic() - began) * 1000), df.rdd.getNumPartitions())], "rows_produced long, execution_time_ms long, batches_processed long")
        plan = self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return self._rows([(line,) for line in plan.split("\n")], "plan string")

    # ------------------------------------------------------------ continuous queries
    def view(self, name: str, path: str | None = None) -> View:
        """The epochs kept of a stream or view (under ``path``, or the session's shared folder)."""
        if name not in self.views:
            x = self.catalog.get(name, "stream", "view")
            retain = x.options.get("retain_history")
            self.views[name] = View(self.spark, path or streaming.scratch(self.spark), "append", int(re.sub(r"\D", "", retain)) if retain else None)
        return self.views[name]

    def run_cycle(self, name: str) -> int:
        """Take one epoch of a stream or view from the current snapshot; its number."""
        v = self.view(name)
        epoch = (v.epochs() or [-1])[-1] + 1
        v(self.spark.table(name), epoch)
        return epoch

    def start(self, name: str, source: DataFrame | None = None, *, sink=None, available: bool = True, checkpoint: str | None = None):
        """Run a stream on streaming sources: ``source`` replaces its first source, or connectors give it."""
        x = self.catalog.get(name, "stream", "view")
        src = next((self.catalog.objects[n] for n in [*x.inputs, *self.catalog.upstream(name)] if self.catalog.objects[n].kind == "source"), None)
        if source is None:
            if src is None or not src.connector:
                raise StreamError(f"{name} has no streaming source")
            schema = StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in src.columns))
            source = connectors.source(self.spark, src.connector, schema, src.options, streaming=True)
        if src is not None and src.watermark:
            source = streaming.with_watermark(source, src.watermark[0], f"{src.watermark[1]} us")
        alias = f"stream_{uuid.uuid4().hex}"
        source.createOrReplaceTempView(alias)
        body = renamed(rewrite.split_emit(x.sql).sql, src.name, alias) if src else x.sql
        q = rewrite.rewrite(self.spark, body)
        mode = streaming.output_mode(x.emit, q.windowed) if x.emit or q.windowed else "append"
        query = streaming.start(self.spark.sql(q.sql), mode=mode, sink=sink or self.view(name), available=available, checkpoint=checkpoint)
        self.running[name] = query
        return query

    def stop(self, name: str) -> None:
        if q := self.running.pop(name, None):
            q.stop()

    def shutdown(self) -> None:
        for name in list(self.running):
            self.stop(name)

    def checkpoint(self) -> str:
        """Wait until running queries have committed what is available."""
        for q in self.running.values():
            if q.isActive:
                q.processAllAvailable()
        return "CHECKPOINT"

    def flush(self, sink: str) -> int:
        """Write a sink's rows now: its input, filtered, through its connector; the number of rows."""
        x = self.catalog.get(sink, "sink")
        df = self.spark.table(x.inputs[0])
        if x.where:
            df = df.filter(x.where)
        if changelog.WEIGHT in df.columns and x.options.get("changelog") != "true":
            df = changelog.positive(df)
        if x.connector == "memory":
            df.createOrReplaceTempView(sink)
        else:
            connectors.sink(df, x.connector, {k: v for k, v in x.options.items() if k != "changelog"})
        return df.count()

    def subscribe(self, name: str, where: str | None = None, as_of: int | None = None) -> Subscription:
        return Subscription(self.view(name), where, as_of)

    def _subscribe(self, text: str, ts: list[lex.Token]) -> Subscription:
        m = re.match(r"(?is)SUBSCRIBE\s+(\w+)(?:\s+WHERE\s+(.+?))?(?:\s+AS\s+OF\s+EPOCH\s+(\d+))?\s*$", text)
        if not m:
            raise SqlError(f"cannot read {text!r}")
        return self.subscribe(m[1], m[2], None if m[3] is None else int(m[3]))

    def topology(self) -> list[tuple[str, str, list[str]]]:
        return [(n, self.catalog.objects[n].kind, self.catalog.objects[n].inputs) for n in self.catalog.order()]


def renamed(sql: str, name: str, to: str) -> str:
    """A query that reads ``to`` in the place of ``name``; string literals stay as they are."""
    for t in reversed(lex.tokens(sql)):
        if t.kind in ("word", "name") and lex.name_of(t.text) == name:
            sql = sql[: t.start] + to + sql[t.end :]
    return sql


def open_engine(spark: SparkSession | None = None) -> Engine:
    """An engine on a session, or on a new one."""
    from eddyflow.session import session

    return Engine(spark or session())


