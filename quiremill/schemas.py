"""Declared input schemas. The y axis grows up in `items` and down in `elements` unless a view says otherwise."""

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

_DDL = {
    "files": "file_id LONG, batch STRING, name STRING, size LONG, mtime TIMESTAMP, content BINARY",
    "items": "doc_id LONG, page INT, item_no INT, str STRING, x DOUBLE, y DOUBLE, size DOUBLE, width DOUBLE",
    "raw_items": "doc_id LONG, page INT, item_no INT, str STRING, transform ARRAY<DOUBLE>, width DOUBLE, height DOUBLE",
    "chars": "doc_id LONG, page INT, block INT, line INT, span INT, char_no INT, c STRING, x0 DOUBLE, y0 DOUBLE, "
             "x1 DOUBLE, y1 DOUBLE, origin_x DOUBLE, font STRING, size DOUBLE, flags INT, color INT, syn BOOLEAN",
    "elements": "doc_id LONG, page INT, el_id INT, kind STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, "
                "text STRING, size DOUBLE, bold BOOLEAN, page_w DOUBLE, page_h DOUBLE",
    "tables": "doc_id LONG, page INT, table_no INT, method STRING, rows ARRAY<ARRAY<STRING>>",
    "frames": "stream STRING, frame_no LONG, ts TIMESTAMP, w INT, h INT, channels INT, px ARRAY<INT>",
    "logs": "job STRING, seq LONG, ts TIMESTAMP, line STRING",
    "progress": "path STRING, ts TIMESTAMP, loaded LONG, total LONG",
    "coverage": "font STRING, cp_start INT, cp_end INT",
}


def schema(name: str) -> StructType:
    """StructType of a named input (needs an active SparkSession)."""
    return _parse_datatype_string(_DDL[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Check that `df` has the columns of a declared input and cast them to the declared types."""
    wanted = schema(name)
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in wanted])
