"""Declared shape of each topic, and the mapping from registered record schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Payload times are zone-less, so they are zone-less here too: their value does not
# depend on the session time zone. Streams cast to TIMESTAMP for watermarks.
TIME = TimestampNTZType()
AMOUNT = DecimalType(18, 2)


@dataclass(frozen=True)
class Contract:
    """What a topic promises: columns, key, whether records supersede, enum values."""

    topic: str
    schema: StructType
    key: tuple[str, ...]
    compacted: bool = False
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _struct(**columns: DataType) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in columns.items()])


_S = StringType()

# Topic names, column names, types, keys and enum symbols of the data.
EXECUTIONS = Contract(
    "etd.executions",
    _struct(exec_id=_S, order_id=_S, contract_series=_S, side=_S, quantity=AMOUNT,
            price=AMOUNT, executing_member=_S, exec_time=TIME),
    ("exec_id",),
    enums={"side": ("BUY", "SELL")},
)
CLEARING_EVENTS = Contract(
    "etd.clearing-events",
    _struct(event_id=_S, event_type=_S, exec_id=_S, clearing_member_id=_S, account=_S,
            event_time=TIME),
    ("event_id",),
    enums={"event_type": ("NOVATION", "GIVE_UP", "TAKE_UP", "POSITION_NETTING",
                          "TRADE_CORRECTION")},
)
POSITIONS = Contract(
    "etd.positions",
    _struct(position_key=_S, clearing_member_id=_S, account=_S, contract_series=_S,
            net_quantity=AMOUNT, as_of_time=TIME),
    ("clearing_member_id", "account", "contract_series"),
    compacted=True,
)
TRADE_REPORTS = Contract(
    "emir.trade-reports",
    _struct(report_id=_S, uti=_S, counterparty_1=_S, counterparty_2=_S, exec_id=_S,
            action_type=_S, notional=AMOUNT, notional_currency=_S, reporting_timestamp=TIME),
    ("report_id",),
    enums={"action_type": ("NEWT", "MODI", "EROR", "TERM")},
)
CONTRACTS_REF = Contract(
    "refdata.contracts",
    _struct(contract_series=_S, product_type=_S, underlying=_S, contract_multiplier=AMOUNT,
            expiry_date=DateType()),
    ("contract_series",),
    compacted=True,
    enums={"product_type": ("FUTURE", "OPTION")},
)
CONTRACTS = {
    c.topic: c
    for c in (EXECUTIONS, CLEARING_EVENTS, POSITIONS, TRADE_REPORTS, CONTRACTS_REF)
}

# Primitive and logical type names of Avro schemas.
PRIMITIVES: dict[str, DataType] = {
    "string": StringType(),
    "int": IntegerType(),
    "long": LongType(),
    "float": FloatType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "bytes": BinaryType(),
}
LOGICAL: dict[str, DataType] = {
    "timestamp-millis": TIME,
    "timestamp-micros": TIME,
    "local-timestamp-millis": TIME,
    "local-timestamp-micros": TIME,
    "date": DateType(),
    "time-millis": StringType(),
    "uuid": StringType(),
}


def spark_type(avro) -> DataType:
    """Spark type of one registered field type.

    A union with several non-null members becomes a string, as does an unknown type.
    """
    if isinstance(avro, list):
        members = [t for t in avro if t != "null"]
        return spark_type(members[0]) if len(members) == 1 else StringType()
    if isinstance(avro, str):
        return PRIMITIVES.get(avro, StringType())
    kind, logical = avro.get("type"), avro.get("logicalType")
    if logical == "decimal":
        return DecimalType(avro.get("precision", 38), avro.get("scale", 0))
    if logical in LOGICAL:
        return LOGICAL[logical]
    if kind == "record":
        return record_type(avro)
    if kind == "array":
        return ArrayType(spark_type(avro["items"]))
    if kind == "map":
        return MapType(StringType(), spark_type(avro["values"]))
    if kind == "fixed":
        return BinaryType()
    if kind == "enum":
        return StringType()
    return spark_type(kind)


def record_type(record: dict) -> StructType:
    return StructType(
        [
            StructField(f["name"], spark_type(f["type"]), _nullable(f["type"]))
            for f in record.get("fields", [])
        ]
    )


def _nullable(avro) -> bool:
    return isinstance(avro, list) and "null" in avro


def registered_contract(
    topic: str, value: dict, key: dict | None = None, default_key: tuple[str, ...] = (),
    compacted: bool = False,
) -> Contract:
    """A contract from a topic's registered value and key schemas.

    The key comes from the key schema, else from ``default_key``, else it is the
    first field.
    """
    schema = record_type(value)
    if key and key.get("type") == "record":
        names = tuple(f["name"] for f in key["fields"])
    else:
        names = tuple(default_key) or (schema.names[0],)
    enums = {
        f["name"]: tuple(f["type"]["symbols"])
        for f in value["fields"]
        if isinstance(f["type"], dict) and f["type"].get("type") == "enum"
    }
    return Contract(topic, schema, names, compacted, enums)


def text_schema(schema: StructType) -> StructType:
    """The same top-level fields, all as strings: what a payload says before casting."""
    return StructType([StructField(f.name, StringType()) for f in schema.fields])
