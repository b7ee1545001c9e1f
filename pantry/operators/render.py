"""Markdown of the four results.

Each result becomes a title, sheets (a table with a heading each) and notes; one writer puts them down. Which fields a
sheet has, their units and what is said where a value is absent stand in the tables below. Every value is written in
full; nothing is cut here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pantry.operators.compare import CompareResult
from pantry.operators.lookup import LookupResult
from pantry.operators.search import SearchResult
from pantry.operators.vocabulary import VocabularyResult

NONE = "N/A"
SOURCE = "Entered by many hands: what is missing here has not been entered yet."

#: (field, what is said when it was asked for and is absent; None: the row is left out)
RECORD: tuple[tuple[str, str | None], ...] = (
    ("product_name", "Unknown product"),
    ("brands", None),
    ("quantity", None),
    ("serving_size", None),
    ("serving_quantity", None),
    ("nutriscore_grade", None),
    ("nova_group", None),
    ("ecoscore_grade", None),
    ("nutriments", "Not available"),
    ("ingredients_text", "Not available"),
    ("allergens_tags", "Not entered, which does not mean free of allergens"),
    ("additives_tags", None),
    ("categories_tags", None),
    ("labels_tags", None),
    ("packaging_tags", None),
    ("origins_tags", None),
    ("image_url", None),
    ("completeness", None),
    ("data_quality_tags", None),
)
NOT_REQUESTED = "Not requested"
#: Units of the named nutrients that are no grams.
UNITS = {"energy_kcal": "kcal"}
PER = ("100g", "serving")
COMPARED = ("energy_kcal_100g", "fat_100g", "saturated_fat_100g", "sugars_100g", "salt_100g", "proteins_100g", "fiber_100g")
LEVELS = ((0.8, "high"), (0.5, "moderate"), (-math.inf, "low: many fields are missing"))


@dataclass
class Sheet:
    heading: str
    columns: tuple[str, ...]
    rows: list[tuple] = field(default_factory=list)


def num(x: float | int | None) -> str:
    """A number without a trailing .0 and without an exponent."""
    if x is None:
        return NONE
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        return str(int(x))
    text = repr(x)
    return format(x, "f" if "e-" not in text else f".{len(text.split('e-')[0].replace('.', '').lstrip('-')) - 1 + int(text.split('e-')[1])}f") if "e" in text else text


def percent(x: float) -> str:
    return f"{math.floor(x * 100 + 0.5)}%"


def cell(value: object) -> str:
    """A value as it stands in a table: lists joined, numbers plain, absent ones named so; no cell ends a row early."""
    if value is None or value == "":
        text = NONE
    elif isinstance(value, bool):
        text = str(value).lower()
    elif isinstance(value, (int, float)):
        text = num(value)
    elif isinstance(value, (list, tuple)):
        text = ", ".join(map(str, value)) or NONE
    else:
        text = str(value)
    return text.replace("|", "\\|").replace("\r\n", "\n").replace("\n", "<br>")


def write(title: str, sheets: list[Sheet], notes: list[str | None]) -> str:
    out = [f"# {title}"]
    for s in sheets:
        if s.rows:
            out += ["", f"## {s.heading}", "", f"| {' | '.join(s.columns)} |", "|" + " --- |" * len(s.columns)]
            out += [f"| {' | '.join(map(cell, row))} |" for row in s.rows]
    said = [f"> {n}" for n in notes if n]
    return "\n".join([*out, "", *said] if said else out)


def _completeness(x: float | None) -> str | None:
    return None if x is None else f"{percent(x)} ({num(x)}, {next(word for least, word in LEVELS if x >= least)})"


def _value(name: str, product: dict) -> object:
    """What the record says of a field; for the nested ones, where to look."""
    value = product.get(name)
    if name == "completeness":
        return _completeness(value)
    if name == "serving_quantity" and value is not None:
        return f"{num(value)} {product.get('serving_quantity_unit') or '(unit not recorded)'}"
    if name == "nutriments" and value:
        return "see below"
    return value or None if isinstance(value, (dict, list, str)) else value


def _nutrients(n: dict) -> list[tuple]:
    """A row a nutrient: its figure per 100 g and per serving."""
    figures: dict[str, dict[str, str]] = {}
    for key, value in n.items():
        base, _, per = key.rpartition("_")
        if base == "additional":
            for name, entry in value.items():
                figures.setdefault(name, {})[per] = " ".join(x for x in (num(entry["value"]), entry.get("unit")) if x)
        elif value is not None:
            figures.setdefault(base, {})[per] = f"{num(value)} {UNITS.get(base, 'g')}"
    return [(name, *[own.get(per) for per in PER]) for name, own in figures.items()]


def lookup(r: LookupResult) -> str:
    p, asked = r.product, r.requested_fields
    rows: list[tuple] = [("barcode", r.barcode)]
    for name, absent in RECORD:
        value = _value(name, p)
        if value is None and absent is not None:
            value = NOT_REQUESTED if asked is not None and name not in asked else absent
        if value is not None:
            rows.append((name, value))
    nutrients = _nutrients(p.get("nutriments") or {})
    ingredients = [tuple(i.get(k) for k in ("text", "id", "percent_estimate", "vegan", "vegetarian")) for i in p.get("ingredients") or []]
    notes = [
        f"Only these fields were requested: {', '.join(asked)}." if asked else None,
        "No serving size is recorded: what the figures per serving refer to is unknown." if any(row[2] for row in nutrients) and not p.get("serving_size") else None,
        SOURCE,
    ]
    sheets = [Sheet("Record", ("Field", "Value"), rows), Sheet("Nutrients", ("Nutrient", "Per 100 g", "Per serving"), nutrients), Sheet("Ingredients as parsed", ("Text", "Id", "Percent (estimate)", "Vegan", "Vegetarian"), ingredients)]
    return write(p.get("product_name") or "Unknown product", sheets, notes)


def search(r: SearchResult) -> str:
    names = ("barcode", "product_name", "brands", "nutriscore_grade", "nova_group", "ecoscore_grade", "categories_tags")
    found = Sheet("Products", names, [tuple(p.get(n) for n in names) for p in r.products])
    count = f"{r.total}{'+' if r.total_is_lower_bound else ''}"
    title = f"{count} products match, {r.page_count} on page {r.page}" if r.products else f"No products found (total: {count})"
    bound = f"At least {r.total} match; counting stops there. Filters make the number exact." if r.total_is_lower_bound else None
    return write(title, [found], [bound, r.notice, SOURCE if r.products else None])


def compare(r: CompareResult) -> str:
    scores = ("nutriscore_grade", "nova_group", "ecoscore_grade")
    names = ("barcode", "found", "product_name", "brands", *scores, "completeness")
    rows = [tuple(_completeness(p.get(n)) if n == "completeness" else p.get(n) for n in names) for p in r.products]
    nutrients = [(p["barcode"], *[p.get(n) for n in COMPARED]) for p in r.products if p["found"]]
    failed = [(f["barcode"], f["reason"], f["error"]) for f in r.failed or []]
    notes = [
        f"Not found (not entered yet): {', '.join(r.not_found)}" if r.not_found else None,
        f"Under 50% complete, so many fields may be missing: {', '.join(r.low_completeness)}" if r.low_completeness else None,
        "Those that could not be read are not known to be missing." if failed else None,
        SOURCE,
    ]
    sheets = [Sheet("Products", names, rows), Sheet("Per 100 g", ("barcode", *COMPARED), nutrients), Sheet("Could not be read", ("barcode", "reason", "error"), failed)]
    return write(f"{r.succeeded} of {len(r.products) + len(failed)} products found", sheets, notes)


def vocabulary(r: VocabularyResult) -> str:
    counted = any(t.get("products") is not None for t in r.tags)
    columns = ("id", "name", *(["products"] if counted else []))
    rows = [(t["id"], t["name"], *([None if t.get("products") is None else f"{t['products']:,}"] if counted else [])) for t in r.tags]
    title = f"{r.facet}: {len(r.tags)} entries" + (f" of {r.total_in_facet}" if r.total_in_facet is not None else "")
    return write(title, [Sheet("Entries", columns, rows)], [r.notice, "Ids are used exactly as they stand here." if r.tags else None])
