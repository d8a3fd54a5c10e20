"""Predicates over drawing texts and the class maps of reference designators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of designators, values, labels and rails, and the three class maps.
REF = r"^(?:[A-Z][0-9]{1,4}|[A-Z]{2}[0-9]{1,2})[A-Z]?$"
VALUE = (
    r"^(?:[0-9]+[RrKkMmGgNnPpFf][0-9]*|[0-9]+(?:[.][0-9]+)?\s*[kKMGmnupfTμΩµ]{1,2}[FfHhΩzZ]?|[+-]?[0-9]+(?:[.][0-9]+)?[Vv]"
    r"|[0-9]+[Vv][0-9]+|[0-9][A-Z][A-Z0-9]{2,}|[A-Z]{2,4}[0-9]{2,})$"
)
LABEL = r"^[A-Za-z0-9_+/\-]+$"
RAIL = r"(?i)^(GND|VCC|VDD|VEE|VSS|AGND|DGND|AVDD|AVCC|\+[0-9]+V?|\+[0-9]*\.?[0-9]+V|3V3|5V|12V|24V|VBAT|VBUS|VREF|VMEM)\b"
POWER = ("GND", "VCC", "VDD", "VSS", "VEE", "PWR", "+", "VBUS", "GROUND")
#: How sure the rules are of a class: of most, of some by two letters, and of some by the first letter.
RULE_SURE, RULE_SURE_2 = 0.95, {"VR": 0.90, "RN": 0.90, "FB": 0.85, "TR": 0.85}
RULE_SURE_1 = {"U": 0.90, "P": 0.90, "X": 0.90, "T": 0.90, "S": 0.85, "M": 0.70}
TOOL_CLASSES = {
    "R": "resistor", "C": "capacitor", "L": "inductor", "D": "diode", "Q": "transistor", "U": "IC", "J": "connector", "P": "connector", "K": "relay",
    "Y": "crystal", "F": "fuse", "SW": "switch", "RV": "potentiometer", "TP": "test point", "LED": "LED", "V": "tube", "T": "transformer",
}
RULE_CLASSES_2 = {"TP": "testpoint", "SW": "switch", "VR": "regulator", "IC": "ic", "RN": "resistor", "FB": "inductor", "TR": "transformer"}
RULE_CLASSES_1 = {
    "R": "resistor", "C": "capacitor", "L": "inductor", "D": "diode", "Q": "transistor", "U": "ic", "J": "connector", "P": "connector", "Y": "crystal",
    "X": "crystal", "F": "fuse", "T": "transformer", "K": "relay", "S": "switch", "M": "ic",
}
DETECTOR_CLASSES = {
    "R": "resistor", "RV": "potentiometer", "RN": "resistor", "C": "capacitor", "L": "inductor", "D": "diode", "LED": "diode", "Q": "transistor", "U": "ic",
    "IC": "ic", "X": "crystal", "Y": "crystal", "J": "connector", "P": "connector", "CN": "connector", "K": "relay", "SW": "switch", "S": "switch",
    "F": "fuse", "T": "transformer", "TP": "testpoint", "BT": "battery", "B": "battery",
}


def is_ref(text: Column) -> Column:
    return F.trim(text).rlike(REF)


def is_value(text: Column) -> Column:
    return ~is_ref(text) & F.trim(text).rlike(VALUE)


def is_net_label(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) > 0) & (F.length(t) <= 50) & ~is_ref(text) & ~is_value(text) & t.rlike(LABEL)


def is_rail(name: Column) -> Column:
    return name.rlike(RAIL)


def lookup(prefix: Column, classes: dict[str, str]) -> Column:
    """The class of a prefix, null where there is none."""
    return F.get(F.transform(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in classes.items())), lambda e: e["k"] == prefix), lambda e: e["v"]), F.lit(0))


def tool_class(ref: Column) -> Column:
    """By the leading letters: all of them, then one fewer, then the first."""
    letters = F.regexp_extract(F.upper(ref), "^([A-Z]+)", 1)
    return F.coalesce(lookup(letters, TOOL_CLASSES), lookup(F.substring(letters, F.lit(1), F.greatest(F.length(letters) - 1, F.lit(1))), TOOL_CLASSES), lookup(F.substring(letters, 1, 1), TOOL_CLASSES), F.lit("component"))


def rule_class(ref: Column) -> Column:
    """Two letters before the number with a meaning of their own, else the first letter."""
    letters = F.regexp_extract(F.upper(ref), r"^([A-Z]+)\d", 1)
    return F.coalesce(lookup(F.substring(letters, 1, 2), RULE_CLASSES_2), lookup(F.substring(letters, 1, 1), RULE_CLASSES_1), F.lit("unknown"))


def rule_class_or_null(ref: Column) -> Column:
    """The class and confidence of a designator with a number, as struct<name,confidence>; null for one that names none.

    The confidence is RULE_SURE for a first letter's class and higher for those of two letters.
    """
    letters = F.regexp_extract(F.upper(ref), r"^([A-Z]+)\d", 1)
    two, one = lookup(F.substring(letters, 1, 2), RULE_CLASSES_2), lookup(F.substring(letters, 1, 1), RULE_CLASSES_1)
    two = F.when(F.length(letters) >= 2, two)
    name = F.coalesce(two, one)
    return F.when(name.isNotNull(), F.struct(name.alias("name"), _sure(letters, two.isNotNull()).alias("confidence")))


def _sure(letters: Column, two: Column) -> Column:
    def of(values: dict[str, float], n: int) -> Column:
        out = F.lit(RULE_SURE)
        for k, v in values.items():
            out = F.when(F.substring(letters, 1, n) == k, v).otherwise(out)
        return out

    return F.when(two, of(RULE_SURE_2, 2)).otherwise(of(RULE_SURE_1, 1))


def rule_classified(ref: Column, segments: str, shapes: str) -> Column:
    """struct<name,confidence> of a component by its designator, else by its drawing: counts of segments and shapes, and its box bx0..by1."""
    w, h = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    ratio = F.when(h > 0, F.try_divide(w, h)).otherwise(1.0)
    of = lambda name, sure: F.struct(F.lit(name).alias("name"), F.lit(sure).alias("confidence"))
    drawn = F.when((F.col(segments) <= 4) & (F.col(shapes) == 0) & (w * h < 400), of("power_symbol", 0.45)).when((ratio > 3) & (F.col(segments) > 4), of("ic", 0.35)).otherwise(of("unknown", 0.25))
    return F.coalesce(rule_class_or_null(ref), drawn)


def detector_class(ref: Column) -> Column:
    """The longest of three, two or one of the designator's letters that names a class."""
    letters = F.regexp_replace(ref, "[^A-Za-z]", "")
    return F.coalesce(*(lookup(F.substring(letters, 1, n), DETECTOR_CLASSES) for n in (3, 2, 1)), F.lit("other"))


def is_power(name: Column) -> Column:
    """A net name that has one of POWER anywhere."""
    found = F.lit(False)
    for token in POWER:
        found = found | F.upper(name).contains(token)
    return found


def is_sheet(schematic: Column, parts: Column) -> Column:
    """A schematic that mainly holds other sheets: it names their files and has five parts at most."""
    return schematic.contains("Sheetfile") & (parts <= 5)


def known_class(class_name: Column, ref: Column) -> Column:
    """A component's class, from its designator where it is empty or unknown; unknown where that says nothing either."""
    by_ref = tool_class(ref)
    return F.coalesce(F.when((class_name != "") & (class_name != "unknown"), class_name), F.when(by_ref == "component", "unknown").otherwise(by_ref), F.lit("unknown"))


def net_name(name: Column, net: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), net.cast("string"))


def net_type(name: Column) -> Column:
    return F.when(is_rail(name), "power rail").otherwise("signal net")


def describe_component(ref: Column, class_name: Column, value: Column) -> Column:
    """As 'R1 (resistor, 10k)'; values that are empty or the word None aren't named."""
    shown = F.when(value.isNotNull() & (value != "") & (value != "None"), F.concat(F.lit(", "), value)).otherwise("")
    return F.concat(ref, F.lit(" ("), known_class(class_name, ref), shown, F.lit(")"))


def describe_net(name: Column) -> Column:
    return F.concat(name, F.lit(" ("), net_type(name), F.lit(")"))


def source_format(producer: Column, creator: Column, first_page: Column) -> Column:
    """Which program drew a document: by its metadata, else by what its first page says."""
    made = F.lower(F.concat(F.coalesce(producer, F.lit("")), F.coalesce(creator, F.lit(""))))
    text = F.coalesce(first_page, F.lit(""))
    out = F.when(made.contains("kicad"), "kicad").when(made.contains("altium"), "altium").when(made.contains("eagle"), "eagle")
    out = out.when(text.contains("Sheet") & text.contains("Date:") & text.rlike(r"[A-Z]\d{1,4}"), "altium")
    return out.when(F.upper(text).contains("KICAD") | text.contains(".kicad_sch"), "kicad").otherwise("unknown")


def visible_characters(text: Column) -> Column:
    """Characters other than white space."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f\\x0b]", ""))
