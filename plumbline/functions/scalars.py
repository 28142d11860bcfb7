"""Scalar expressions: text normalisers, error rate, boxes, angles, rounding, budgets (all JVM-side)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the score normaliser unifies, and those that the check normaliser does besides.
WIDE, PLAIN = "～〜－—（），、º˚＜", "~~--(),,°°<"
WIDE_CHECK, PLAIN_CHECK = "：？！；", ":?!;"


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def norm_reading(text) -> Column:
    """Wave dashes unified, white space out."""
    return F.regexp_replace(F.translate(_c(text), "～〜", "~~"), r"(?U)\s+", "")


def norm_score(text) -> Column:
    """Dashes, brackets, commas, degree and less-than signs unified, white space out."""
    return F.regexp_replace(F.translate(_c(text), WIDE, PLAIN), r"(?U)\s+", "")


def norm_check(text) -> Column:
    """As norm_score, with full-width colon, question, exclamation and semicolon unified too."""
    return F.regexp_replace(F.translate(_c(text), WIDE + WIDE_CHECK, PLAIN + PLAIN_CHECK), r"(?U)\s+", "")


def cer(pred, truth) -> Column:
    """Character error rate; 0 for an empty truth; may pass 1.  Both sides normalised by the caller."""
    n = F.length(_c(truth))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(_c(pred), _c(truth)) / n)


def half_even(x, places: int = 0) -> Column:
    return F.bround(_c(x), places)


def half_even_double(x, places: int = 0) -> Column:
    """Of the double as it is, moved by ``places``, as SQL's round_even: 0.575 lies below its tie (``half_even`` takes the
    shortest decimal for the value)."""
    return F.rint(_c(x) * 10.0**places) / 10.0**places


def iou(a: list, b: list) -> Column:
    """Of boxes [x0, y0, x1, y1]; 1e-9 in the denominator keeps empty boxes defined."""
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = map(_c, [*a, *b])
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    inter = w * h
    return inter / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter + F.lit(1e-9))


def in_grown_box(cx, cy, box: list, share: float = 0.25, pad: float = 2) -> Column:
    """Whether a centre lies in the box grown by a share of its sides and a pad, edges included."""
    x0, y0, x1, y1 = map(_c, box)
    gx, gy = (x1 - x0) * share + pad, (y1 - y0) * share + pad
    return _c(cx).between(x0 - gx, x1 + gx) & _c(cy).between(y0 - gy, y1 + gy)


def effective_width(text) -> Column:
    """Wide characters count 1, all others half."""
    narrow = F.length(F.regexp_replace(_c(text), "[⺀-￯]", ""))
    return (F.length(_c(text)) - narrow) + narrow * 0.5


def font_size(width_pt, text) -> Column:
    return half_even(_c(width_pt) / F.greatest(effective_width(text), F.lit(0.5)), 1)


def placement(tight: list, text, text_height, angle, scale) -> Column:
    """Where a label goes, in source pixels (one is a point): centre, width, height, font size and angle, 1 place."""
    x0, y0, x1, y1 = map(_c, tight)
    k, width, n = _c(scale), (x1 - x0) / _c(scale), effective_width(text)
    height = F.coalesce(_c(text_height), F.lit(0.0)) / k
    size = F.when(n > 0, width / n).otherwise(height)
    values = {"cx": (x0 + x1) / 2.0 / k, "cy": (y0 + y1) / 2.0 / k, "width_pt": width, "height_pt": height, "font_size_pt": size, "angle": F.coalesce(_c(angle), F.lit(0.0))}
    return F.struct(*(half_even(v, 1).alias(name) for name, v in values.items()))


def angle_between(a, b) -> Column:
    """Between undirected lines, in radians."""
    d = F.pmod(_c(a) - _c(b), F.lit(pi))
    return F.least(d, pi - d)


def degree_digits(text) -> Column:
    """The digits of a reading that may be a degree label, or null."""
    m = F.regexp_extract(norm_reading(text), "^(\\d{1,3})([0oO°º*96'\"]?)$", 1)
    return F.when(m != "", m)


def degree_label(text, glyphs) -> Column:
    """struct(text, note) of a reading that is a degree label by its glyphs (x, y, w, h), else null.

    A small glyph in the upper part, right of the large ones, is the degree sign.  A trailing character that isn't a
    digit was that sign misread; so was the last digit, where there are fewer large glyphs than digits.
    """
    glyphs, top = _c(glyphs), norm_reading(text)
    tallest = F.array_max(F.transform(glyphs, lambda g: g["h"]))
    large = F.filter(glyphs, lambda g: g["h"] >= 0.6 * tallest)
    middle = F.array_min(F.transform(large, lambda g: g["y"] + g["h"] / 2.0))
    right = F.array_max(F.transform(large, lambda g: g["x"] + g["w"] / 2.0))
    sign = F.exists(glyphs, lambda g: (g["h"] <= 0.55 * tallest) & (g["y"] + g["h"] <= middle + 1) & (g["x"] + g["w"] / 2.0 > right))
    digits = degree_digits(text)
    short = (F.length(top) == F.length(digits)) & (F.size(large) < F.length(digits)) & (F.length(digits) >= 2)
    kept = F.when(short & (F.size(large) >= 2), F.substr(digits, F.lit(1), F.length(digits) - 1)).otherwise(digits)
    note = F.when(short & (F.size(large) < 2), "degree sign found but digits merged: check the number")
    return F.when(digits.isNotNull() & (F.size(glyphs) > 0) & sign, F.struct(F.concat(kept, F.lit("°")).alias("text"), note.alias("note")))


def roman_like(text) -> Column:
    return F.rlike(_c(text), F.lit(r"^[IVXLTAl1|\-·.]+$"))


def has_cjk(text) -> Column:
    return F.rlike(_c(text), F.lit("[一-鿿]"))


def numeric_with_unit(text) -> Column:
    return F.rlike(_c(text), F.lit(r"^[<>]?[\d.,~\-]+(°|km|m|Ma)?$"))


def prefix_completion(old, new, score) -> Column:
    """'replace' where the new reading completes the old one's start, 'uncertain' where it is sure but other, else null."""
    old, new = _c(old), _c(new)
    more = F.length(new) - F.length(old)
    whole = F.endswith(F.lower(new), F.lower(old)) & (more > 0) & (more <= F.greatest(F.lit(3), F.floor(F.length(old) / 2)))
    usable = (new != "") & (new != old)
    return F.when(usable & whole, "replace").when(usable & (_c(score) >= 0.8), "uncertain")


def work_scale(width, height, chosen=None, most: float = 6e6) -> Column:
    """The chosen scale, else 1 where twice the size passes ``most`` pixels, else 2."""
    auto = F.when(4 * _c(width) * _c(height) > most, 1).otherwise(2)
    return auto if chosen is None else F.coalesce(_c(chosen), auto)


def time_budget(layers, labels, rules, marks, tiles) -> Column:
    """Seconds allowed for a build, between 240 and 900."""
    raw = 120 + 30 * _c(layers) + 0.5 * _c(labels) + 0.1 * _c(rules) + 0.02 * _c(marks) + 4 * _c(tiles)
    return F.least(F.lit(900.0), F.greatest(F.lit(240.0), raw))


def split_label(text) -> Column:
    return F.split(_c(text), r"\|")


def or_default(x, default: float) -> Column:
    """Null and 0 both give way to the default, as the issue rules read a missing metric."""
    return F.coalesce(F.nullif(_c(x), F.lit(0)), F.lit(default))


def strip_size(angle_deg, box_w, box_h, least_den: float = 0.3) -> Column:
    """struct(length, height) of a slanted strip from its upright box; null near 45 degrees, where it can't be told."""
    s, c = F.abs(F.sin(F.radians(_c(angle_deg)))), F.abs(F.cos(F.radians(_c(angle_deg))))
    den = c * c - s * s
    return F.when(F.abs(den) >= least_den, F.struct(((_c(box_w) * c - _c(box_h) * s) / den).alias("length"), ((_c(box_h) * c - _c(box_w) * s) / den).alias("height")))


def label_id(number) -> Column:
    return F.concat(F.lit("L"), _c(number).cast("string"))


def label_number(name) -> Column:
    """The number in a label's id (L3 or l3), null for all other ids."""
    return F.nullif(F.regexp_extract(F.trim(_c(name)), "^[Ll]([0-9]+)$", 1), F.lit("")).cast("int")


def switched_on(value) -> Column:
    """Whether an environment value turns its switch on; a name that begins with NO_ turns it off in the same way."""
    return F.coalesce(F.lower(F.trim(_c(value))).isin("1", "true", "yes"), F.lit(False))


def lab(b, g, r) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* (D65) of 8-bit blue, green, red."""

    def linear(v):
        v = _c(v) / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754

    def f(t):
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)

    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def lab8(b, g, r) -> tuple[Column, Column, Column]:
    """L, a, b of 8-bit pictures: L over 0 to 255, a and b around 128, whole numbers."""
    light, a, bb = lab(b, g, r)
    return F.round(light * 255 / 100), F.round(a + 128), F.round(bb + 128)


def chroma(a, b) -> Column:
    return F.hypot(_c(a), _c(b))


def hue(a, b) -> Column:
    return F.atan2(_c(b), _c(a))


def hue_apart(a, b) -> Column:
    """Between two hues, in radians, at most pi."""
    d = F.pmod(_c(a) - _c(b), F.lit(2 * pi))
    return F.least(d, 2 * pi - d)


def delta_e(p: list, q: list) -> Column:
    return F.sqrt(sum(((_c(x) - _c(y)) * (_c(x) - _c(y)) for x, y in zip(p, q)), F.lit(0.0)))
