"""Column functions for names, times and escapes of transcripts. Letters are folded as ASCII, times as C's printf prints them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r" \t\n\x0B\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim(c: Column) -> Column:
    """Without C white space at either end."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def iequals(a: Column, b: Column) -> Column:
    return lower(a) == lower(b)


def display_name(name: Column, ident: Column) -> Column:
    """The name, or SPEAKER_ and the id in four digits at least."""
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.format_string("SPEAKER_%04d", ident))


def local_label(n: Column) -> Column:
    return F.format_string("speaker_%02d", n)


def _parts(total: Column) -> tuple[Column, Column, Column]:
    return (total - total % 3600) / 3600, (total % 3600 - total % 60) / 60, total % 60


def timestamp(seconds: Column, comma: bool) -> Column:
    """HH:MM:SS,mmm; negative times are 0, hours may pass 99."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5)
    h, m, s = _parts(F.floor(ms / 1000))
    return F.format_string("%02d:%02d:%02d" + ("," if comma else ".") + "%03d", h.cast("long"), m.cast("long"), s, ms % 1000)


def duration(seconds: Column) -> Column:
    """1h 02m, 1m 02s or 5s."""
    total = F.floor(F.greatest(seconds, F.lit(0.0)) + 0.5)
    h, m, s = (x.cast("long") for x in _parts(total))
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def clock(seconds: Column) -> Column:
    """h:mm:ss or m:ss; --:-- for what isn't above 0."""
    total = F.floor(seconds + 0.5)
    h, m, s = (x.cast("long") for x in _parts(total))
    shown = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "--:--").otherwise(shown)


def stamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm with milliseconds rounded inside the second, carried if they reach 1000."""
    x = F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), 0.0).otherwise(seconds)
    whole = F.floor(x)
    ms = whole * 1000 + F.floor((x - whole) * 1000 + 0.5)
    h, m, s = _parts(F.floor(ms / 1000))
    return F.format_string("%02d:%02d:%02d.%03d", h.cast("long"), m.cast("long"), s, ms % 1000)


def sanitise_filename(c: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(c, r'[\x00-\x1F<>:"/\\|?*]', "_"), "[. ]+$", "")
    return F.when(clean == "", "untitled").otherwise(clean)


def escape_json(c: Column) -> Column:
    for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(plain), F.lit(shown))
    for code in [*range(8), 11, *range(14, 32)]:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return c


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+\-.!|])", r"\\$1")


def fixed(x: Column, places: int, width: int = 0) -> Column:
    """A number with so many places, right-aligned in the width; values midway between two numbers go to the even one."""
    return F.format_string(f"%{width or ''}.{places}f", F.bround(x, places))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is worked out once."""
    return F.transform(F.array(value), f)[0]


def _below_tie(size: Column, shown: Column) -> Column:
    """Whether C rounds size, shown with seven digits, to six digits down where Java, which looks at the shortest digits, rounds up: a seventh digit 5 is the last, and the exact value is less, or equal and the
    sixth digit even."""
    digits, power = F.substring_index(shown, "e", 1), F.substring_index(shown, "e", -1).cast("int")

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    def over(scale: Column) -> Column:
        (a, b), (c, d), p = halves(size), halves(scale), size * scale
        return (p - F.replace(digits, F.lit("."), F.lit("")).cast("double")) + (((a * c - p) + a * d + b * c) + b * d)  # with what the product has lost

    exact = F.when(power >= 6, 0.0).otherwise(_let(F.concat(F.lit("1e"), (6 - power).cast("string")).cast("double"), over))
    least = F.when(F.substring(digits, 7, 1).isin("0", "2", "4", "6", "8"), F.lit(0.0)).otherwise(F.lit(-5e-324))
    return digits.endswith("5") & (shown.cast("double") == size) & (exact <= least)


def general(x: Column) -> Column:
    """A number as C's %g prints it: six digits, an exponent below 1e-4 and from 1e6; exact ties to even."""

    def bare(shown: Column) -> Column:
        return F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)

    def shown(x: Column, sci: Column) -> Column:
        power = F.substring_index(sci, "e", -1).cast("int")
        plain = F.format_string("%.0f", x)
        for p in range(4, -5, -1):
            plain = F.when(power <= p, F.format_string(f"%.{5 - p}f", x)).otherwise(plain)
        far = F.concat(bare(F.substring_index(sci, "e", 1)), F.lit("e"), F.substring_index(sci, "e", -1))
        return F.when(x == 0, "0").when((power < -4) | (power >= 6), far).otherwise(_let(plain, bare))

    def rounded(x: Column) -> Column:
        return _let(F.format_string("%.6e", F.abs(x)), lambda s: F.when(_below_tie(F.abs(x), s), x * (1 - 1e-9)).otherwise(x))

    return _let(x, lambda x: _let(rounded(x), lambda y: _let(F.format_string("%.5e", y), lambda sci: shown(y, sci))))


def common_root(paths: Column) -> Column:
    """The longest folder that all paths of an array share; empty if there is none."""
    parents = F.transform(paths, lambda p: F.split(F.regexp_replace(p, "/[^/]*$", ""), "/", -1))
    first = F.element_at(parents, 1)

    def shared(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        n = F.array_position(same, False)
        return F.when(n > 0, F.slice(a, F.lit(1), (n - 1).cast("int"))).otherwise(a)

    root = F.array_join(F.aggregate(parents, first, shared), "/")
    return F.when(F.size(paths) > 0, F.when((root == "") & F.startswith(F.element_at(paths, 1), F.lit("/")), "/").otherwise(root)).otherwise("")


def output_path(root: Column, source: Column, track: Column, tracks: Column, fmt: Column, mirror: Column | None = None) -> Column:
    """Where a transcript goes: root, the source's folder below mirror (if it lies there), its stem, .trackN where there are several, the format in small letters."""
    folder, name = F.regexp_replace(source, "/[^/]*$", ""), F.substring_index(source, "/", -1)
    below = F.lit("") if mirror is None else F.when(F.startswith(folder, F.concat(mirror, F.lit("/"))), F.concat(F.substring(folder, F.length(mirror) + 2, F.length(folder)), F.lit("/"))).otherwise("")
    stem = F.when(F.regexp_like(name, F.lit(r"^.+\.[^.]*$")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    shown = F.concat(sanitise_filename(stem), F.when(tracks > 1, F.concat(F.lit(".track"), (track + 1).cast("string"))).otherwise(""), F.lit("."), lower(fmt))
    return F.concat(root, F.lit("/"), below, shown)


# Tints of speakers, by their number. Fixed values.
TINTS = ("#8caaee", "#e78284", "#a6d189", "#e5c890", "#ca9ee6", "#81c8be", "#ef9f76", "#85c1dc", "#f4b8e4", "#babbf1", "#eebebe", "#99d1db", "#e8a2af", "#c6d0f5", "#a5adce", "#f0a868")


def colour(id_: Column) -> Column:
    """The tint of an identity as #rrggbb, one of as many as there are, in turn; null below 0 and for null."""
    return F.when(id_ >= 0, F.element_at(F.array(*[F.lit(x) for x in TINTS]), (id_ % len(TINTS) + 1).cast("int")))


def prompt(start: Column, words: Column) -> Column:
    """What a recogniser is told first: the prompt given, then the words that are expected, in a list that ends with a full stop."""
    listed = F.concat(F.array_join(words, ", "), F.lit("."))
    return F.when(F.size(words) == 0, start).when(start == "", listed).otherwise(F.concat(start, F.lit(" "), listed))
