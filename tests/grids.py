"""Small sheets as cell rows."""

from unitwise import schema
from unitwise.functions.fixed_values import UNIT_COLUMNS


def js_text(v):
    if isinstance(v, str):
        return v
    return str(int(v)) if float(v).is_integer() else repr(float(v))


def cell_rows(doc, sheet, grid, first_col=0, fmt=None):
    """Array of arrays to cells; None means no cell, '' an empty-string cell."""
    for r, line in enumerate(grid):
        for c, v in enumerate(line):
            if v is None:
                continue
            num = isinstance(v, (int, float))
            yield (doc, sheet, r, c + first_col, "n" if num else "s", js_text(v),
                   float(v) if num else None, (fmt or {}).get(c) if num else None)


def cells(spark, *sheets):
    data = [row for s in sheets for row in s]
    return spark.createDataFrame(data, schema.CELLS)


def structure(doc, sheet, layout="row", start=2, header=1, columns=None, block=None,
              charge_columns=(), total=None, skip=(), stop=(), stated=None, summary=None, extra=()):
    cols = tuple((columns or {}).get(c) for c in UNIT_COLUMNS)
    return (doc, sheet, layout, start, header, cols, block, list(charge_columns), total,
            list(skip), list(stop), stated, summary, list(extra))


def structures(spark, *rows):
    return spark.createDataFrame(list(rows), schema.STRUCTURES)
