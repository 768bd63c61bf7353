"""Tables under a warehouse root: declared, appended to, and read as of a snapshot.

Layout (all Parquet)::

    <root>/registry/tables/namespace=<ns>/table_name=<t>/snapshot_seq=<n>/  one row
    <root>/registry/claims/namespace=<ns>/table_name=<t>/snapshot_seq=<n>/  who writes it
    <root>/registry/indexes/namespace=<ns>/table_name=<t>/event_seq=<n>/    one row
    <root>/data/<ns>/<t>-<uuid>/snapshot_seq=<n>/              rows added by snapshot n

A snapshot becomes visible only when its registry row is written, and published files
are never rewritten. An append that dies leaves files no read looks at, and running it
again overwrites exactly those. An append claims its snapshot before it writes, so of two
at once at most one goes on and the other fails with ``ConcurrentChange``.

The registry is the durable truth; the session catalog only gets views over it, so that
``SELECT * FROM ns.t`` works and any later session can rebuild them. A view looks the newest
snapshot up when it is read, so appends need not touch it.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import run_folder
from tidemark.sources.conform import Conformed, conform
from tidemark.sources.documents import to_struct

SNAPSHOT = "snapshot_seq"



def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


TABLE_EVENTS = _schema(
    table_uuid=T.StringType(),
    snapshot_seq=T.LongType(),
    metadata_location=T.StringType(),
    table_path=T.StringType(),
    schema_document=T.StringType(),
    added_rows=T.LongType(),
    total_rows=T.LongType(),
    committed_at=T.TimestampType(),
)
INDEX_EVENTS = _schema(
    table_uuid=T.StringType(),
    event_seq=T.LongType(),
    event=T.StringType(),
    index_name=T.StringType(),
    index_type=T.StringType(),
    metadata_location=T.StringType(),
    index_path=T.StringType(),
    columns=T.ArrayType(T.StringType()),
    params_json=T.StringType(),
    row_count=T.LongType(),
    partition_count=T.LongType(),
    largest_partition_rows=T.LongType(),
    recorded_at=T.TimestampType(),
)
CLAIM_EVENTS = _schema(
    snapshot_seq=T.LongType(),
    token=T.StringType(),
    held=T.BooleanType(),
    recorded_at=T.TimestampType(),
)
SEQUENCE = {"tables": SNAPSHOT, "indexes": "event_seq", "claims": SNAPSHOT}
_ADDRESS = _schema(namespace=T.StringType(), table_name=T.StringType())
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class TableNotFound(LookupError):
    pass


class SnapshotNotFound(LookupError):
    pass


class ConcurrentChange(RuntimeError):
    """Another writer holds or has taken the number this change was to have."""


class RejectedRows(ValueError):
    """An append met rows the schema refuses; ``counts`` says how many failed each check."""

    def __init__(self, table: str, rejected: int, counts: dict[str, int]):
        super().__init__(f"{table}: {rejected} rows refused: {counts}")
        self.rejected = rejected
        self.counts = counts


@dataclass(frozen=True)
class TableState:
    """One table as of one snapshot."""

    namespace: str
    table_name: str
    table_uuid: str
    snapshot_seq: int
    metadata_location: str
    table_path: str
    schema_document: str
    total_rows: int

    @property
    def schema(self) -> T.StructType:
        return to_struct(self.schema_document)


@dataclass(frozen=True)
class Appended:
    state: TableState
    rejects: DataFrame | None


class Lakehouse:
    def __init__(self, spark: SparkSession, root: str, catalog_namespace: str = "lake_catalog"):
        if "`" in root:
            raise ValueError("the root path must not hold a backtick")
        self.spark = spark
        self.root = root.rstrip("/")
        self.catalog_namespace = _checked_name(catalog_namespace)
        for kind, events in (("tables", TABLE_EVENTS), ("indexes", INDEX_EVENTS)):
            self._write_empty(kind, events, "_none", "_none")
        self._create_catalog_views()

    # -- namespaces and tables ---------------------------------------------------

    def create_namespace(self, namespace: str, properties_json: str = "{}") -> str:
        """Create a namespace with a JSON bag of properties; an existing one is kept."""
        properties = json.loads(properties_json)
        if not isinstance(properties, dict):
            raise ValueError("namespace properties must be a JSON object")
        clause = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in properties.items())
        clause = f" WITH DBPROPERTIES ({clause})" if clause else ""
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {_checked_name(namespace)}{clause}")
        return namespace

    def create_table(self, namespace: str, table_name: str, schema_document: str) -> TableState:
        """Declare a table; it can be selected from at once, with no rows."""
        schema = to_struct(schema_document)
        _checked_name(namespace), _checked_name(table_name)
        table_uuid = str(uuid.uuid4())
        path = f"{self.root}/data/{namespace}/{table_name}-{table_uuid}"
        state = TableState(
            namespace, table_name, table_uuid, 0, f"{path}#0", path, _compact(schema_document), 0
        )
        _no_rows(self.spark, schema.fields).write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}=0")
        self._write_empty("indexes", INDEX_EVENTS, namespace, table_name)
        try:
            self._record_snapshot(state, 0, mode="errorifexists")
        except ConcurrentChange:
            if self._newest(namespace, table_name) is not None:
                raise ValueError(f"table {namespace}.{table_name} exists") from None
            self._record_snapshot(state, 0)  # the folder of a creation that never finished
        self._create_table_view(state)
        return state

    def append(
        self,
        namespace: str,
        table_name: str,
        rows: DataFrame,
        on_reject: str = "fail",
        lossy: str = "refuse",
        take_over: bool = False,
    ) -> Appended:
        """Write ``rows`` as the table's next snapshot, in one pass and without a shuffle.

        ``on_reject="fail"`` publishes nothing if any row is refused. ``"split"`` publishes
        the good rows and hands back the refused ones: ``rows`` are worked out once, by a job that
        writes them to the shared folder in two parts, and each half reads its own.
        ``lossy="allow"`` lets casts round values. An append that was killed still holds its
        claim; ``take_over=True`` goes on in its place, once it is known to be dead.
        """
        if on_reject not in ("fail", "split"):
            raise ValueError(f"on_reject must be 'fail' or 'split', not {on_reject!r}")
        now = self.state(namespace, table_name)
        checked = conform(rows, now.schema, lossy)
        rejects = None
        if on_reject == "split":
            rows, refused = self._split(checked)
            rejects = conform(refused, now.schema, lossy).rejects
            checked = conform(rows, now.schema, lossy)
        token = self._claim(now, take_over)
        try:
            state = self._write_snapshot(now, checked, rows, on_reject)
        except BaseException:
            self._write_claim(now, token, held=False)
            raise
        if not self.spark.catalog.tableExists(f"{namespace}.{table_name}"):
            self._create_table_view(state)
        return Appended(state, rejects)

    def _split(self, checked: Conformed) -> tuple[DataFrame, DataFrame]:
        """Rows as they came, good ones and refused ones, from files that one job wrote."""
        rows, flag = checked.source, "_refused"
        while flag.lower() in (name.lower() for name in rows.columns):
            flag += "_"
        folder = run_folder(self.spark, "split")
        split = rows.withColumn(flag, checked.failed).write.partitionBy(flag)
        split.option("compression", "zstd").parquet(folder)
        fields = [*rows.schema.fields, T.StructField(flag, T.BooleanType())]
        parts = self.spark.read.schema(T.StructType(fields)).parquet(folder)
        good, refused = parts.where(~F.col(flag)), parts.where(F.col(flag))
        return good.drop(flag), refused.drop(flag)

    def _write_snapshot(
        self, now: TableState, checked: Conformed, rows: DataFrame, on_reject: str
    ) -> TableState:
        labels = list(checked.checks)
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(checked.failed).alias("refused")]
        for number, label in enumerate(labels):
            counts.append(F.count_if(checked.checks[label]).alias(f"check_{number}"))
        number = now.snapshot_seq + 1
        accepted = replace(checked, source=rows.observe(seen, *counts)).accepted
        files = f"{now.table_path}/{SNAPSHOT}={number}"
        accepted.write.mode("overwrite").option("compression", "zstd").parquet(files)
        metrics = seen.get
        refused = metrics["refused"]
        if refused and on_reject == "fail":
            by_check = {label: metrics[f"check_{i}"] for i, label in enumerate(labels)}
            raise RejectedRows(
                f"{now.namespace}.{now.table_name}",
                refused,
                {k: v for k, v in by_check.items() if v},
            )
        added = metrics["rows"] - refused
        state = replace(
            now,
            snapshot_seq=number,
            metadata_location=f"{now.table_path}#{number}",
            total_rows=now.total_rows + added,
        )
        self._record_snapshot(state, added, mode="errorifexists")
        return state

    def _claim(self, now: TableState, take_over: bool) -> str:
        """Claim the snapshot after ``now``: at most one of several writers gets past this.

        Each writes its claim first and then looks for others', so the later one sees both.
        """
        token, number = str(uuid.uuid4()), now.snapshot_seq + 1
        self._write_claim(now, token, held=True)
        path = self._event_path("claims", now.namespace, now.table_name)
        fields = [field for field in CLAIM_EVENTS.fields if field.name != SNAPSHOT]
        claims = self.spark.read.schema(T.StructType(fields)).parquet(f"{path}/{SNAPSHOT}={number}")
        found = claims.select("token", "held").collect()
        given_up = {row["token"] for row in found if not row["held"]}
        others = {row["token"] for row in found} - given_up - {token}
        if others and not take_over:
            problem = f"another append to {now.namespace}.{now.table_name} is under way"
        elif self._newest(now.namespace, now.table_name).snapshot_seq != now.snapshot_seq:
            problem = f"{now.namespace}.{now.table_name} has grown since it was looked up"
        else:
            return token
        self._write_claim(now, token, held=False)
        raise ConcurrentChange(problem)

    def _write_claim(self, now: TableState, token: str, held: bool) -> None:
        row = {SNAPSHOT: now.snapshot_seq + 1, "token": token, "held": held, "recorded_at": _now()}
        self._write_event("claims", CLAIM_EVENTS, now.namespace, now.table_name, row, "append")

    # -- reads -------------------------------------------------------------------

    def state(
        self, namespace: str, table_name: str, metadata_location: str | None = None
    ) -> TableState:
        """The newest state of a table, or the one a ``metadata_location`` names."""
        found = self._newest(namespace, table_name, metadata_location)
        if found is None:
            raise SnapshotNotFound(f"{namespace}.{table_name} has no state {metadata_location!r}")
        return found

    def scan(
        self,
        namespace: str,
        table_name: str,
        metadata_location: str | None = None,
        file_io_config_json: str = "{}",
    ) -> DataFrame:
        """All rows of a table as of one snapshot; the newest if none is named."""
        state = self.state(namespace, table_name, metadata_location)
        return self.scan_state(state, file_io_config_json)

    def scan_state(self, state: TableState, file_io_config_json: str = "{}") -> DataFrame:
        files = self.scan_files(state, file_io_config_json)
        return files.select(*[f"`{name}`" for name in state.schema.names])

    def scan_files(
        self, state: TableState, file_io_config_json: str = "{}", after: int = -1
    ) -> DataFrame:
        """As ``scan_state`` with the partition column and hidden ``_metadata`` still there; of
        snapshots after a number only, where one is given."""
        schema = T.StructType([*state.schema.fields, T.StructField(SNAPSHOT, T.LongType())])
        reader = self.spark.read.schema(schema).options(**json.loads(file_io_config_json))
        # Folders by name, so that later snapshots are not even listed.
        folders = [f"{state.table_path}/{SNAPSHOT}={n}" for n in range(after + 1, state.snapshot_seq + 1)]
        files = reader.option("basePath", state.table_path).parquet(*folders)
        return files.where(F.col(SNAPSHOT) <= state.snapshot_seq)

    # -- registries as relations -------------------------------------------------

    def table_events(self) -> DataFrame:
        return self._events("tables", TABLE_EVENTS)

    def index_events(self) -> DataFrame:
        return self._events("indexes", INDEX_EVENTS)

    def tables_internal(self) -> DataFrame:
        """One row per table: its newest state."""
        return self.spark.table(f"{self.catalog_namespace}.tables_internal")

    def table_schemas(self) -> DataFrame:
        """One row per declared column: ``table_uuid, field_name, field_type, field_position``."""
        return self.spark.table(f"{self.catalog_namespace}.table_schemas")

    def refresh_views(self) -> None:
        """Give this session a view for every registered table."""
        for row in self.tables_internal().select("namespace", "table_name").toLocalIterator():
            self._create_table_view(self.state(row.namespace, row.table_name))

    # -- events ------------------------------------------------------------------

    def index_events_of(self, namespace: str, table_name: str) -> DataFrame:
        return self._events_of("indexes", INDEX_EVENTS, namespace, table_name)

    def record_index_event(self, namespace: str, table_name: str, event: dict) -> None:
        last = self._last("indexes", INDEX_EVENTS, namespace, table_name)
        row = {**event, "event_seq": last + 1, "recorded_at": _now()}
        self._write_event("indexes", INDEX_EVENTS, namespace, table_name, row, "errorifexists")

    def _last(self, kind: str, schema: T.StructType, namespace: str, table_name: str) -> int:
        """The highest number of a table's events, from a listing; no file is opened."""
        files = self._events_of(kind, schema, namespace, table_name).inputFiles()
        numbers = [re.search(rf"/{SEQUENCE[kind]}=(\d+)/[^/]*$", file) for file in files]
        return max((int(found[1]) for found in numbers if found), default=0)

    def _newest(
        self, namespace: str, table_name: str, metadata_location: str | None = None
    ) -> TableState | None:
        """A state from the one folder that records it, however many others there are."""
        if metadata_location is None:
            number = self._last("tables", TABLE_EVENTS, namespace, table_name)
        else:
            number = snapshot_number(metadata_location)
        path = self._event_path("tables", _checked_name(namespace), _checked_name(table_name))
        fields = [field for field in TABLE_EVENTS.fields if field.name != SNAPSHOT]
        reader = self.spark.read.schema(T.StructType(fields))
        try:
            events = reader.parquet(f"{path}/{SNAPSHOT}={number}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            self._events_of("tables", TABLE_EVENTS, namespace, table_name)  # raises without a table
            return None
        if metadata_location is not None:
            events = events.where(F.col("metadata_location") == metadata_location)
        row = events.limit(1).collect()
        if not row:
            return None
        names = TableState.__dataclass_fields__.keys() - {"namespace", "table_name", SNAPSHOT}
        values = {name: row[0][name] for name in names}
        return TableState(namespace, table_name, snapshot_seq=number, **values)

    def _record_snapshot(self, state: TableState, added: int, mode: str = "overwrite") -> None:
        row = {
            "table_uuid": state.table_uuid,
            "snapshot_seq": state.snapshot_seq,
            "metadata_location": state.metadata_location,
            "table_path": state.table_path,
            "schema_document": state.schema_document,
            "added_rows": added,
            "total_rows": state.total_rows,
            "committed_at": _now(),
        }
        self._write_event("tables", TABLE_EVENTS, state.namespace, state.table_name, row, mode)

    def _write_event(
        self,
        kind: str,
        schema: T.StructType,
        namespace: str,
        table_name: str,
        row: dict,
        mode: str = "overwrite",
    ) -> None:
        number = SEQUENCE[kind]
        values = [
            F.lit(row[f.name]).cast(f.dataType).alias(f.name)
            for f in schema.fields
            if f.name != number
        ]
        path = f"{self._event_path(kind, namespace, table_name)}/{number}={row[number]}"
        event = self.spark.range(0, 1, 1, 1).select(*values)
        try:
            event.write.mode(mode).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise ConcurrentChange(f"{namespace}.{table_name} already has {path}") from None

    def _write_empty(
        self, kind: str, schema: T.StructType, namespace: str, table_name: str
    ) -> None:
        """No events, but a folder to read and the schema in it."""
        number = SEQUENCE[kind]
        path = f"{self._event_path(kind, namespace, table_name)}/{number}=0"
        fields = [field for field in schema.fields if field.name != number]
        _no_rows(self.spark, fields).write.mode("ignore").parquet(path)

    def _event_path(self, kind: str, namespace: str, table_name: str) -> str:
        return f"{self.root}/registry/{kind}/namespace={namespace}/table_name={table_name}"

    def _events(self, kind: str, schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, *_ADDRESS.fields])
        return self.spark.read.schema(whole).parquet(f"{self.root}/registry/{kind}")

    def _events_of(
        self, kind: str, schema: T.StructType, namespace: str, table_name: str
    ) -> DataFrame:
        """One table's events from its own folder, however large the registry is."""
        path = self._event_path(kind, _checked_name(namespace), _checked_name(table_name))
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                raise TableNotFound(f"no table {namespace}.{table_name}") from None
            raise

    # -- session views -----------------------------------------------------------

    def _create_catalog_views(self) -> None:
        ns = self.catalog_namespace
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {ns}")
        self.spark.sql(
            f"""
            CREATE OR REPLACE VIEW {ns}.tables_internal AS
            SELECT namespace, table_name, state.*
            FROM (
                SELECT namespace, table_name,
                       max_by(struct(table_uuid, metadata_location,
                                     CAST(snapshot_seq AS BIGINT) AS snapshot_seq, total_rows,
                                     schema_document, committed_at), snapshot_seq) AS state
                FROM parquet.`{self.root}/registry/tables`
                GROUP BY namespace, table_name
            )
            """
        )
        self.spark.sql(
            f"""
            CREATE OR REPLACE VIEW {ns}.table_schemas AS
            SELECT table_uuid, field.name AS field_name, field.type AS field_type,
                   CAST(place + 1 AS BIGINT) AS field_position
            FROM (
                SELECT table_uuid,
                       posexplode(from_json(
                           get_json_object(schema_document, '$.fields'),
                           'array<struct<name: string, type: string>>')) AS (place, field)
                FROM {ns}.tables_internal
            )
            """
        )

    def _create_table_view(self, state: TableState) -> None:
        columns = ", ".join(f"`{name}`" for name in state.schema.names)
        registry = self._event_path("tables", state.namespace, state.table_name)
        self.create_namespace(state.namespace)
        self.spark.sql(
            f"""
            CREATE OR REPLACE VIEW {state.namespace}.{state.table_name} AS
            SELECT {columns} FROM parquet.`{state.table_path}`
            WHERE {SNAPSHOT} <= (SELECT max({SNAPSHOT}) FROM parquet.`{registry}`)
            """
        )


def _no_rows(spark: SparkSession, fields: list[T.StructField]) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def snapshot_number(metadata_location: str) -> int:
    """The number of the snapshot that a location names; -1 if it names none."""
    number = metadata_location.rpartition("#")[2]
    return int(number) if number.isdecimal() else -1


def _checked_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is not a name of letters, digits and underscores")
    return name


def _quoted(value) -> str:
    text = value if isinstance(value, str) else json.dumps(value)
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _compact(document: str | dict) -> str:
    body = json.loads(document) if isinstance(document, str) else document
    return json.dumps(body, separators=(",", ":"))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()
