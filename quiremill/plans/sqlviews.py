"""The derived views once more, as DuckDB common table expressions for the cross-checks."""

import re

from ..sources.views import EXTS, HEADS


def sql_list(items):
    return "[" + ",".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_VIEWS = {
    "f_files": f"""SELECT doc_id, doc_id AS pos,
        CASE WHEN doc_id % 5 < 3 THEN source || '-m' || (doc_id % 6) ELSE source || '-x' || (doc_id % 12) END AS batch,
        CASE WHEN doc_id % 24 = 23 THEN source || '_' || doc_id ELSE source || '_' || doc_id || '.' ||
          CASE WHEN (doc_id // 24) % 3 = 0 THEN upper({sql_list(EXTS)}[doc_id % 24 + 1]) ELSE {sql_list(EXTS)}[doc_id % 24 + 1] END
        END AS name, n_chars AS size FROM documents""",
    "f_ext": """SELECT *, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '([^.]*)$', 1)) ELSE '' END AS ext,
        CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE name END AS stem FROM f_files""",
    "f_heads": f"""SELECT f.*, {sql_list(HEADS)}[(doc_id + doc_id // 24) % 12 + 1] || CASE WHEN doc_id % 4 = 0 THEN
        '45006E006300720079007000740069006F006E0049006E0066006F00' ELSE '' END || hex(encode(text)) AS hx
        FROM f_ext f JOIN documents USING (doc_id)""",
    "f_lines": """SELECT doc_id, (line_no // 12)::INT AS page, line_no::INT AS line_no, text, 800 - 14 * (line_no % 12) AS y,
        72 AS x0, 72 + 6 * length(text) AS x1 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
        unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)""",
    "f_items": """SELECT doc_id, page, line_no, item_no::INT AS item_no, str,
        (72 + 6 * coalesce(sum(length(str) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY item_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS x, y, 10 AS size, 6 * length(str) AS width
        FROM (SELECT doc_id, page, line_no, y, unnest(string_split(text, ' ')) AS str,
              unnest(range(len(string_split(text, ' ')))) AS item_no FROM f_lines)""",
    "f_chars": """SELECT doc_id, page, line, span, char_no, c, x0, x0 + 6 AS x1, y0, y0 + 10 AS y1, 10 AS size,
        CASE WHEN (span // 3) % 2 = 0 THEN 'Arial' ELSE 'Batang' END AS font,
        CASE WHEN (span // 5) % 2 = 0 THEN 0 ELSE 16 END AS flags, 0 AS color,
        c = ' ' AND (doc_id + span) % 3 = 0 AS syn
        FROM (SELECT doc_id, page, line_no AS line, item_no AS span, y AS y0, k AS char_no, x + 6 * k AS x0,
              substr(str || ' ', k + 1, 1) AS c
              FROM (SELECT *, unnest(range(length(str) + 1))::INT AS k FROM f_items))""",
    "f_sized": """SELECT *, greatest(1, list_sort(list(length(text)) OVER (PARTITION BY doc_id, page))[greatest(1, ceil(0.75 * count(*) OVER (PARTITION BY doc_id, page)))::INT]) AS extent FROM f_lines""",
    "f_elements": """SELECT doc_id, page, line_no AS el_id, CASE WHEN line_no % 5 = 4 OR line_no % 2 = 0 THEN 72 ELSE 320 END AS x0,
        y AS y0, CASE WHEN line_no % 5 = 4 THEN 550 ELSE (CASE WHEN line_no % 2 = 0 THEN 72 ELSE 320 END)
          + 220 * length(text) // extent END AS x1, y + 10 AS y1, text, 10 AS size FROM f_sized""",
    "f_sheets": """SELECT *, greatest(1, list_sort(list(length(text)) OVER (PARTITION BY doc_id, line_no // 48))[greatest(1, ceil(0.75 * count(*) OVER (PARTITION BY doc_id, line_no // 48)))::INT]) AS extent FROM f_lines""",
    "f_columns": """SELECT doc_id, line_no // 48 AS page, line_no AS el_id,
        CASE WHEN line_no % 9 = 8 OR line_no % 2 = 0 THEN 72 ELSE 320 END AS x0,
        14 * ((line_no % 48) // 2) + 40 AS y0,
        CASE WHEN line_no % 9 = 8 THEN 550 ELSE CASE WHEN line_no % 2 = 0 THEN 72 ELSE 320 END + 120 + 100 * length(text) // extent END AS x1,
        14 * ((line_no % 48) // 2) + 50 AS y1, text, 10 AS size FROM f_sheets""",
    "f_cells": """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
        [format('{:,.2f}', l_extendedprice), CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR),
         CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 1 THEN ''
              ELSE ' ' || l_returnflag || '  ' || chr(9) || l_linestatus || ' ' END] AS cells FROM lineitem""",
    "f_tables": """SELECT o_custkey AS doc_id, o_orderkey AS table_no, row_no,
        CASE WHEN o_orderkey % 3 = 0 THEN cells[1:2] ELSE cells END AS cells
        FROM f_cells c JOIN orders o ON c.doc_id = o.o_orderkey
        UNION ALL SELECT o_custkey, o_orderkey, 0, CASE WHEN o_orderkey % 3 = 0 THEN ['price','qty'] ELSE ['price','qty','flag'] END
        FROM orders WHERE o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "f_cellboxes": """SELECT tbl, r, col, 72 + 100 * col + l_partkey % 3 AS x0, 160 + 100 * col - l_partkey % 2 AS x1,
        100 + 14 * r AS y0, 112 + 14 * r AS y1, l_partkey, qty
        FROM (SELECT l_orderkey AS tbl, l_partkey, CAST(l_quantity AS INT) AS qty, unnest([0,1,2]) AS col,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r
              FROM lineitem)""",
    "f_frames": """SELECT label AS stream, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_no, vec_id,
        list_transform(embedding, lambda v: floor(3 * v::DOUBLE)::INT) AS px FROM embeddings""",
    "f_pixels": """SELECT vec_id, label, list_concat(list_transform(embedding, lambda v: floor(128 + 127 * v::DOUBLE)::INT), [0, 0]) AS px FROM embeddings""",
    "f_logs": """SELECT user_id AS job, event_id AS seq, ts, event_type, CASE event_type
        WHEN 'view' THEN 'Stream #0:0: Video: ' || ['h264','hevc','vp9'][event_id % 3 + 1] || ', yuv420p(tv), 640x360, ' ||
          CASE WHEN event_id % 5 = 0 THEN '25 tbr' WHEN event_id % 5 = 1 THEN '240 fps' ELSE '29.97 fps' END
        WHEN 'click' THEN 'Stream #0:1: Audio: ' || ['aac','opus'][event_id % 2 + 1] || ', 44100 Hz, ' || (64 + 32 * (event_id % 5)) || ' kb/s'
        WHEN 'signup' THEN 'Duration: 00:0' || (event_id % 10) || ':12.50, start: 0'
        WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN '[3/4] parsing ' WHEN event_id % 4 = 1 THEN '[4/4] writing ' ELSE '' END
          || '(' || (event_id % 9 + 1) || '/10) Page ' || (event_id % 9 + 1)
        ELSE 'Ignore page ' || (event_id % 50) END AS line FROM events""",
    "f_progress": """SELECT user_id AS path, ts, event_id AS seq, CAST(floor(value * 100) AS BIGINT) AS loaded,
        CASE WHEN user_id % 3 = 0 THEN NULL ELSE 1000000 + user_id END AS total FROM events""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the views it mentions (and the views those mention), in dependency order."""
    views = {**_VIEWS, **(extra or {})}
    done: list[str] = []

    def need(text: str) -> None:
        for name in views:
            if name not in done and re.search(rf"\b{name}\b", text):
                need(views[name])
                if name not in done:
                    done.append(name)

    need(body)
    if not done:
        return body
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in done)
    return f"WITH {ctes}\n{body}"
