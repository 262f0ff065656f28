"""The fifteen retrieval views of a state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import col
from trailmark.schemas import ELEMENTS, VIEW_MASKS, VIEWS


def _filled(elements: Column, name: str) -> Column:
    value = elements[name]
    if name in ("question", "task"):
        return F.coalesce(value, F.lit("")) != ""
    return F.coalesce(F.size(value), F.lit(0)) > 0


def element_mask(elements: Column | str) -> Column:
    """Bit mask of the non-empty elements."""
    e = col(elements)
    mask = F.lit(0)
    for i, name in enumerate(ELEMENTS):
        mask = mask + F.when(_filled(e, name), F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def views_of_mask(have: Column) -> Column:
    """Views an element mask allows: a lookup in a literal table, one entry per mask."""
    lists = [[v for v, m in VIEW_MASKS if m & h == m] for h in range(1 << len(ELEMENTS))]
    table = F.array(*[
        F.array(*[F.lit(v) for v in names]) if names else _none() for names in lists
    ])
    return F.get(table, have)


def available_views(elements: Column | str) -> Column:
    """Views whose elements are all present, in view order."""
    return views_of_mask(element_mask(elements))


def view_mask(view: Column | str) -> Column:
    """Bit mask of the elements a view uses."""
    table = F.create_map(*[F.lit(x) for vm in VIEW_MASKS for x in vm])
    return F.try_element_at(table, col(view))


def view_position(view: Column | str) -> Column:
    """0-based position of a view in view order."""
    return F.array_position(F.array(*[F.lit(v) for v in VIEWS]), col(view)).cast("int") - 1


def remaining_views(available: Column | str, used: Column | str) -> Column:
    """Available views not used yet, order kept."""
    taken = F.coalesce(col(used), F.array().cast("array<string>"))
    return F.filter(col(available), lambda v: ~F.array_contains(taken, v))


def compose_view(elements: Column | str, view: Column | str, mask: Column | None = None) -> Column:
    """Struct (text, images): what one view of a state is embedded from.

    ``mask`` is the view's element mask when it is at hand as a column.
    """
    e = col(elements)
    bits = view_mask(view) if mask is None else mask
    has = [bits.bitwiseAND(1 << i) != 0 for i in range(len(ELEMENTS))]
    text = F.concat_ws("\n", *[F.when(h, t) for h, t in zip(has, element_texts(e))])
    images = F.coalesce(F.when(has[ELEMENTS.index("images")], filled_images(e)), _none())
    return F.struct(text.alias("text"), images.alias("images"))


def element_texts(e: Column) -> list[Column]:
    """What each element adds to a view's text, in the order of ``ELEMENTS``; null when it is empty."""
    texts = {
        "question": F.concat(F.lit("Question: "), e["question"]),
        "task": F.concat(F.lit("Task: "), e["task"]),
        "images": F.lit("Images are provided."),
        "observations": F.concat(F.lit("Observation: "), F.array_join(e["observations"], "\nObservation: ")),
    }
    return [F.when(_filled(e, name), texts[name]) for name in ELEMENTS]


def filled_images(e: Column) -> Column:
    """Paths of the images element, blanks dropped; null when it is empty."""
    return F.when(_filled(e, "images"), F.filter(e["images"], lambda p: p.isNotNull() & (p != "")))


def _none() -> Column:
    return F.array().cast("array<string>")
