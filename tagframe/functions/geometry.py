"""Tile grids: numbers of tiles, padding of edge tiles, tiles under a box of pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagframe.functions.binary import as_column


def whole_div(a: Column, b: Column) -> Column:
    """a // b for non-negative whole numbers, null for b = 0."""
    return F.call_function("div", as_column(a).cast("bigint"), F.nullif(as_column(b).cast("bigint"), F.lit(0).cast("bigint")))


def tiles_across(width: Column, tile_width: Column) -> Column:
    return whole_div(width + tile_width - 1, tile_width)


def tiles_down(height: Column, tile_length: Column) -> Column:
    return whole_div(height + tile_length - 1, tile_length)


def padding(size: Column, tile: Column) -> Column:
    """Pixels by which the last tile of an axis goes beyond the image."""
    return F.try_mod(tile - F.try_mod(size, tile), tile).cast("bigint")


def tile_row(tile: Column, width: Column, tile_width: Column) -> Column:
    return whole_div(tile, tiles_across(width, tile_width))


def tile_column(tile: Column, width: Column, tile_width: Column) -> Column:
    return F.try_mod(tile.cast("bigint"), tiles_across(width, tile_width))


def tile_padding(tile: Column, width: Column, height: Column, tile_width: Column, tile_length: Column) -> Column:
    """STRUCT<right, down> of a tile, numbered by rows; the numbers are not checked, so planes behind the first have no bottom row."""
    last_column = tile_column(tile, width, tile_width) == tiles_across(width, tile_width) - 1
    last_row = tile_row(tile, width, tile_width) == tiles_down(height, tile_length) - 1
    zero = F.lit(0).cast("bigint")
    return F.struct(F.when(last_column, padding(width, tile_width)).otherwise(zero).alias("right"), F.when(last_row, padding(height, tile_length)).otherwise(zero).alias("down"))


def box_tiles(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, tile_width: Column, tile_length: Column) -> Column:
    """array<bigint>: numbers of the tiles that a box of pixels (ends exclusive) touches, so a box join is an equi-join on tiles."""
    left, top = F.greatest(x0, F.lit(0)), F.greatest(y0, F.lit(0))
    right, bottom = F.least(x1, width), F.least(y1, height)
    some = (left < right) & (top < bottom)
    columns = F.sequence(whole_div(left, tile_width), whole_div(right - 1, tile_width))
    rows = F.sequence(whole_div(top, tile_length), whole_div(bottom - 1, tile_length))
    across = tiles_across(width, tile_width)
    tiles = F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: r * across + c)))
    return F.when(some, tiles).otherwise(F.array().cast("array<bigint>"))
