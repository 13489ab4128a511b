"""Boxes of a page: printed lines, selections, drags. Words are structs (t, x, y, w, h) in reading order, boxes structs (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Reach of a press, least way out of the text, the same in line heights; height of a line on an empty page.
SNAP, ESCAPE, ESCAPE_LINES, NO_LINE = 0.015, 0.03, 1.5, 0.02
_EDGE = "struct<x0: double, y0: double, x1: double, y1: double>"
_EDGES = f"array<{_EDGE}>"


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def line_boxes(words: Column) -> Column:
    """One box per run of words whose vertical bands overlap the run's by half of the lower height; none for no words, null for null."""
    edges = F.transform(words, lambda w: F.struct(w.x.cast("double").alias("x0"), w.y.cast("double").alias("y0"), (w.x + w.w).cast("double").alias("x1"), (w.y + w.h).cast("double").alias("y1")))

    def step(state: Column, w: Column) -> Column:
        run = state.run
        shared = F.least(run.y1, w.y1) - F.greatest(run.y0, w.y0)
        joins = shared >= 0.5 * F.least(run.y1 - run.y0, w.y1 - w.y0)
        wider = F.struct(F.least(run.x0, w.x0).alias("x0"), F.least(run.y0, w.y0).alias("y0"), F.greatest(run.x1, w.x1).alias("x1"), F.greatest(run.y1, w.y1).alias("y1"))
        ended = F.when(run.isNull(), state.done).otherwise(F.concat(state.done, F.array(run)))
        return F.when(joins, F.struct(state.done.alias("done"), wider.alias("run"))).otherwise(F.struct(ended.alias("done"), w.alias("run")))

    start = F.struct(F.array().alias("done"), F.lit(None).alias("run")).cast(f"struct<done: {_EDGES}, run: {_EDGE}>")
    runs = F.reduce(edges, start, step, lambda s: F.when(s.run.isNull(), s.done).otherwise(F.concat(s.done, F.array(s.run))))
    return F.transform(runs, lambda r: _box(r.x0, r.y0, r.x1, r.y1))


def selection_text(words: Column) -> Column:
    return F.trim(F.array_join(F.transform(words, lambda w: w.t), " "))


def drag_box(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The box between two corners in any order, within the page."""
    inside = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    low, high = (lambda a, b: inside(F.least(a, b))), (lambda a, b: inside(F.greatest(a, b)))
    return _box(low(ax, bx), low(ay, by), high(ax, bx), high(ay, by))


def negligible(box: Column) -> Column:
    return (box.w < 0.01) | (box.h < 0.01)


def nearest_word(words: Column, x: Column, y: Column) -> Column:
    """``struct<dist, idx>`` of the word whose box is nearest to a point, the first of equals; null without words."""
    away = lambda p, lo, size: F.greatest(lo - p, F.lit(0.0), p - (lo + size))
    return F.array_min(F.transform(words, lambda w, i: F.struct(F.hypot(away(x, w.x, w.w), away(y, w.y, w.h)).alias("dist"), i.alias("idx"))))


def median_height(boxes: Column) -> Column:
    """Upper median of the heights of boxes; 0.02 without any."""
    heights = F.array_sort(F.transform(boxes, lambda b: b.h))
    return F.coalesce(F.get(heights, F.floor(F.size(heights) / 2).cast("int")), F.lit(NO_LINE))


def median_line_height(words: Column) -> Column:
    """The same of the printed lines of words."""
    return median_height(line_boxes(words))


def drag(words: Column, press: Column, at: Column, was_text: Column, line: Column) -> Column:
    """``struct<mode, w0, w1, boxes, bbox>`` of a drag from ``press`` (x, y, word) to ``at`` (x, y).

    A press on no word stays a region. From a word it selects text, ``w1``
    exclusive, until the point is farther from the words, or the drag reaches
    farther past the selected lines, than 1.5 line heights; back again only within
    0.015 of a word and half a line. Words and boxes are null for a region.
    """
    box = drag_box(press.x, press.y, at.x, at.y)

    def judge(near: Column) -> Column:
        w0, w1 = F.least(press.word, near.idx), F.greatest(press.word, near.idx) + 1

        def mode(lines: Column) -> Column:
            top, bottom = F.array_min(F.transform(lines, lambda b: b.y)), F.array_max(F.transform(lines, lambda b: b.y + b.h))
            past = F.greatest(top - box.y, box.y + box.h - bottom, F.lit(0.0))
            stays = (near.dist <= F.greatest(F.lit(ESCAPE), ESCAPE_LINES * line)) & (past <= ESCAPE_LINES * line)
            text = press.word.isNotNull() & near.isNotNull() & F.when(was_text, stays).otherwise((near.dist <= SNAP) & (past < 0.5 * line))
            text = F.coalesce(text, F.lit(False))
            only = lambda c: F.when(text, c)
            return F.struct(F.when(text, "text").otherwise("region").alias("mode"), only(w0).alias("w0"), only(w1).alias("w1"), only(lines).alias("boxes"), F.when(~text, box).alias("bbox"))

        return let(line_boxes(F.slice(words, w0 + 1, w1 - w0)), mode)

    return let(nearest_word(words, at.x, at.y), judge)
