"""Named tools over a call table: one column function per tool."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.jsons import unfence
from trailmark.functions.text import col, view_message

ToolFn = Callable[[Column], Column]


@dataclass(frozen=True)
class Param:
    """One parameter of a tool: JSON type, whether it must be there, allowed values, range, or type and number of items."""

    kind: str = "string"
    required: bool = False
    enum: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    items: str | None = None
    item_enum: tuple[str, ...] = ()
    min_items: int | None = None
    max_items: int | None = None


@dataclass(frozen=True)
class Tool:
    """A tool: its parameters, its function of the parameter text, and its descriptions."""

    fn: ToolFn
    params: dict[str, Param] = field(default_factory=dict)
    description: dict[str, str] = field(default_factory=dict)


REGISTRY: dict[str, Tool] = {}


def register_tool(name: str, params: dict[str, Param] | None = None, description: dict[str, str] | None = None):
    """Register a column function under a tool name; a later one of that name replaces it."""

    def add(fn: ToolFn) -> ToolFn:
        REGISTRY[name] = Tool(fn, params or {}, description or {})
        return fn

    return add


def describe_tool(name: str, zh: bool = False) -> str:
    texts = REGISTRY[name].description
    return texts.get("zh" if zh else "en", texts.get("en", ""))


def _is_kind(shape: Column, kind: str) -> Column:
    return {
        "string": shape == "STRING",
        "number": shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL"),
        "array": shape.startswith("ARRAY"),
        "object": shape.startswith("OBJECT"),
        "boolean": shape == "BOOLEAN",
    }[kind]


def _item_checks(v: Column, name: str, rule: Param) -> list[Column]:
    """Rules on the items of an array parameter."""
    items = F.try_variant_get(v, f"$.{name}", "array<variant>")
    checks = []
    if rule.items:
        odd = F.exists(items, lambda i: ~F.coalesce(_is_kind(F.schema_of_variant(i), rule.items), F.lit(False)))
        checks.append(F.when(odd, F.lit(f"'{name}' has an item that is not of type '{rule.items}'")))
    if rule.item_enum:
        words = F.try_variant_get(v, f"$.{name}", "array<string>")
        odd = F.exists(words, lambda w: ~w.isin(*rule.item_enum))
        checks.append(F.when(odd, F.lit(f"'{name}' has an item that is not one of {list(rule.item_enum)}")))
    if rule.min_items is not None:
        checks.append(F.when(F.size(items) < rule.min_items, F.lit(f"'{name}' has less than {rule.min_items} items")))
    if rule.max_items is not None:
        checks.append(F.when(F.size(items) > rule.max_items, F.lit(f"'{name}' has more than {rule.max_items} items")))
    return checks


def params_error(params: Column | str, rules: dict[str, Param]) -> Column:
    """First rule a parameter text breaks, or null. Fenced JSON is accepted."""
    text = unfence(params)
    v = F.try_parse_json(text)
    shape = F.schema_of_variant(v)
    # the message texts of this module are fixed values
    checks = [F.when(v.isNull() | ~shape.startswith("OBJECT"), F.lit("parameters are not a JSON object"))]
    for name, rule in rules.items():
        value = F.try_variant_get(v, f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        here = value.isNotNull()
        wanted = _is_kind(kind, rule.kind)
        if rule.required:
            checks.append(F.when(~here, F.lit(f"'{name}' is a required property")))
        checks.append(F.when(here & ~wanted, F.lit(f"'{name}' is not of type '{rule.kind}'")))
        if rule.enum:
            got = F.try_variant_get(v, f"$.{name}", "string")
            checks.append(F.when(here & ~got.isin(*rule.enum), F.lit(f"'{name}' is not one of {list(rule.enum)}")))
        number = F.try_variant_get(v, f"$.{name}", "double")
        if rule.low is not None:
            checks.append(F.when(here & (number < rule.low), F.lit(f"'{name}' is below {rule.low}")))
        if rule.high is not None:
            checks.append(F.when(here & (number > rule.high), F.lit(f"'{name}' is above {rule.high}")))
        if rule.kind == "array":
            checks += _item_checks(v, name, rule)
    return F.coalesce(*checks)


def validate_params(calls: DataFrame, tool: str = "tool", params: str = "params") -> DataFrame:
    """Add ``error`` per call from the rules of its tool."""
    error = F.lit(None).cast("string")
    for name, t in REGISTRY.items():
        error = F.when(F.col(tool) == name, params_error(params, t.params)).otherwise(error)
    return calls.withColumn("error", error)


def call_tools(calls: DataFrame, tool: str = "tool", params: str = "params") -> DataFrame:
    """Add ``result``: the tool's text, its parameter error, or a message for an unknown tool."""
    result = F.concat(F.lit("Tool "), F.col(tool), F.lit(" does not exist!"))
    for name, t in REGISTRY.items():
        error = params_error(params, t.params)
        value = F.when(
            error.isNotNull(),
            F.concat(F.lit(f"An error occurred when calling tool `{name}`:\n"), error),
        ).otherwise(t.fn(unfence(params)))
        result = F.when(F.col(tool) == name, value).otherwise(result)
    return calls.withColumn("result", result)


def _box_of(params: Column) -> Column:
    numbers = F.from_json(F.get_json_object(params, "$.bbox_2d"), "array<double>")
    return F.struct(
        F.get(numbers, 0).alias("x1"), F.get(numbers, 1).alias("y1"),
        F.get(numbers, 2).alias("x2"), F.get(numbers, 3).alias("y2"),
    )


_BOX = {"image": Param("string", True), "bbox_2d": Param("array", True, items="number", min_items=4, max_items=4)}


def _boxed(text: Callable[[Column], Column]) -> ToolFn:
    from trailmark.functions.geometry import box_error

    def run(params: Column) -> Column:
        error = box_error(_box_of(params))
        return F.when(error.isNotNull(), F.concat(F.lit("Error: "), error)).otherwise(text(params))

    return run


def _property_map(params: Column) -> Column:
    return F.from_json(params, "map<string,string>")


def _described(tool: str) -> Callable[[Column], Column]:
    from trailmark.functions.text import describe_output

    return lambda params: describe_output(F.lit(tool), _property_map(params))


register_tool("crop", _BOX, {"en": "Cut a region out of an image", "zh": "裁剪图像区域"})(_boxed(_described("crop")))
register_tool(
    "zoom_in",
    {**_BOX, "zoom_factor": Param("number", True, low=1.0)},
    {"en": "Enlarge a region of an image", "zh": "放大图像区域"},
)(_boxed(_described("zoom_in")))


@register_tool("get_images", {"images": Param("array", True, items="string")}, {"en": "Show stored images again", "zh": "重新查看图像"})
def _get_images(params: Column) -> Column:
    return view_message(F.from_json(F.get_json_object(params, "$.images"), "array<string>"))
