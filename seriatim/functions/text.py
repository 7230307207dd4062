"""Text columns: numbers, titles, credits, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriatim.functions.bind import whole
from seriatim.functions.urls import SPACE, strip

#: Full-width digits and their ASCII forms.
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"

#: Characters no file name may hold (our choice: what Windows, macOS and Linux refuse together).
UNSAFE_IN_NAMES = r'[\\:*?"<>|\x00-\x1f\x7f]'


def fold_digits(text: Column) -> Column:
    return F.translate(text, WIDE_DIGITS, DIGITS)


def positive_int(text: Column) -> Column:
    """A whole number above zero, white space around it ignored and full-width digits folded; null for anything else."""
    number = whole(F.regexp_extract(fold_digits(text), rf"^{SPACE}*\+?([0-9]+){SPACE}*$", 1))
    return F.when(number > 0, number)


def label_number(label: Column) -> Column:
    """The first run of digits in a label, full-width ones folded."""
    return whole(F.regexp_extract(fold_digits(label), "[0-9]+", 0))


def first_text(*choices: Column) -> Column:
    """The first choice that holds text; ``""`` counts as missing, ``""`` when none does."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in choices], F.lit(""))


def joined(separator: str, *parts: Column) -> Column:
    """The parts that hold text, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def _head(text: Column, separator: str) -> Column:
    """What stands before the first separator."""
    return F.split_part(text, F.lit(separator), F.lit(1))


def _tail(text: Column, separator: str) -> Column:
    """What stands after the first separator; ``""`` without one."""
    place = F.instr(text, separator)
    return F.when(place > 0, F.substr(text, place + len(separator))).otherwise(F.lit(""))


def _titles(series: Column, episode: Column) -> Column:
    return F.struct(series.alias("series"), episode.alias("episode"))


def without_site(heading: Column) -> Column:
    """A page heading without its last `` | site`` part."""
    tail = F.substring_index(heading, " | ", -1)
    held = F.contains(heading, F.lit(" | "))
    return strip(F.when(held, F.substr(heading, F.lit(1), F.length(heading) - F.length(tail) - 3)).otherwise(heading))


def split_middle_dot(heading: Column, share_text: Column, fallback: Column) -> Column:
    """``series・episode | site``; without the dot the share text names the series."""
    head = without_site(heading)
    episode = _tail(head, "・")
    whole = episode == ""
    series = F.when(whole, share_text).otherwise(_head(head, "・"))
    episode = F.when(whole, head).otherwise(episode)
    return _titles(
        _or_else(strip(F.regexp_replace(series, "^#+", "")), fallback), _or_else(strip(episode), fallback)
    )


def _or_else(text: Column, fallback: Column) -> Column:
    return F.when(text == "", fallback).otherwise(text)


def split_dash(heading: Column) -> Column:
    """``work - episode | site``; without the dash everything is the work."""
    head = without_site(heading)
    return _titles(strip(_head(head, " - ")), strip(_tail(head, " - ")))


def bar_part(heading: Column, index: int) -> Column:
    """One part of ``a｜b｜c``, empty parts dropped; ``""`` for the last part or beyond."""
    parts = F.filter(F.transform(F.split(heading, "｜"), strip), lambda p: p != "")
    return F.when(F.size(parts) > index + 1, F.get(parts, F.lit(index))).otherwise(F.lit(""))


def split_brackets(name: Column, fallback: Column) -> Column:
    """``before『work』after``; without brackets the fallback names the work."""
    pattern = r"^([\s\S]*?)『([^』]+)』([\s\S]*)$"
    held = name.rlike(pattern)
    around = strip(
        F.concat(strip(F.regexp_extract(name, pattern, 1)), F.lit(" "), strip(F.regexp_extract(name, pattern, 3)))
    )
    series = F.when(held, strip(F.regexp_extract(name, pattern, 2))).otherwise(fallback)
    return _titles(series, F.when(held & (around != ""), around).otherwise(strip(name)))


def split_known_work(heading: Column, work: Column) -> Column:
    """``work　episode``: by the known work title, else at the first full-width space."""
    known = (work != "") & F.startswith(heading, work)
    rest = strip(F.substr(heading, F.length(work) + 1))
    series = F.when(known, work).otherwise(strip(_head(heading, "　")))
    return _titles(series, F.when(known, rest).otherwise(strip(_tail(heading, "　"))))


def split_by_hint(title: Column, hint: Column) -> Column:
    """``episode - series``; of several dashes, the split the hint opens with as ``series episode``."""
    parts = F.split(title, " - ")
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.struct(
            F.array_join(F.slice(parts, n + 1, F.size(parts)), " - ").alias("series"),
            F.array_join(F.slice(parts, F.lit(1), n), " - ").alias("episode"),
        ),
    )
    told = F.filter(cuts, lambda c: F.startswith(hint, F.concat(c["series"], F.lit(" "), c["episode"])))
    chosen = F.coalesce(F.get(told, F.lit(0)), F.get(cuts, F.lit(0)))
    return F.when(F.size(parts) > 1, chosen).otherwise(_titles(title, title))


def credit(name: Column, role: Column) -> Column:
    """``name (role)``, or the name alone; null without a name."""
    clean, held = strip(name), F.coalesce(strip(role), F.lit(""))
    shown = F.when(held == "", clean).otherwise(F.concat(clean, F.lit(" ("), held, F.lit(")")))
    return F.when(clean != "", shown)


def credits(text: Column, separator: str, mark: str) -> Column:
    """``role<mark>name`` entries as distinct ``name (role)`` entries, first order kept."""
    entries = F.transform(
        F.split(text, separator),
        lambda e: F.when(F.contains(e, F.lit(mark)), credit(_tail(e, mark), _head(e, mark))),
    )
    return F.array_distinct(F.filter(entries, lambda e: e.isNotNull()))


def path_segment(title: Column) -> Column:
    """A title as a directory name: slashes made full-width, unsafe characters out, never empty."""
    name = F.regexp_replace(F.replace(title, F.lit("/"), F.lit("／")), UNSAFE_IN_NAMES, "")
    name = F.regexp_replace(name, r"[ .]+$", "")
    return F.when(name == "", F.lit("_")).otherwise(name)


def publisher_sign(sign: Column) -> Column:
    """The name after ``：``, else the whole sign."""
    held = F.contains(sign, F.lit("："))
    return strip(F.when(held, _tail(sign, "：")).otherwise(sign))


def code_label(code: Column, labels: tuple[str, ...]) -> Column:
    """A small code's label; a code out of range stays a number."""
    names = F.array(*[F.lit(name) for name in labels])
    inside = (code >= 0) & (code < len(labels))
    return F.coalesce(F.when(inside, F.get(names, code.cast("int"))), code.cast("string"))


def title_with_sub(title: Column, subtitle: Column, fallback: Column) -> Column:
    """Main and sub title joined by a space, the fallback when both are missing."""
    return first_text(joined(" ", title, subtitle), fallback)


def volume_title(display: Column, volume: Column) -> Column:
    """The title a site shows, else ``第<n>話``."""
    return F.coalesce(
        F.nullif(display, F.lit("")), F.concat(F.lit("第"), F.coalesce(volume.cast("string"), F.lit("")), F.lit("話"))
    )


#: Endings of button captions, and the caption that names nothing.
CAPTION_ENDING = "(?:を読む|はこちらから|はこちら|を見る)$"
PLAIN_CAPTION = "最新話"


def caption_title(caption: Column, plain: str = PLAIN_CAPTION) -> Column:
    """The episode name a button caption carries, ``""`` when it names none."""
    name = strip(F.regexp_replace(strip(caption), CAPTION_ENDING, ""))
    return F.when(name == plain, F.lit("")).otherwise(name)


#: An episode number inside an "updated" line, and the marks left around the date.
EPISODE_NUMBER = r"第\s*\S+?話"
DATE_MARKS = r"[ 　│|]"


def number_token(updated: Column) -> Column:
    """The ``第…話`` token of an "updated" line, ``""`` without one."""
    return F.regexp_extract(updated, EPISODE_NUMBER, 0)


def date_beside_number(updated: Column) -> Column:
    """What an "updated" line says beside its first number token."""
    rest = F.regexp_replace(updated, rf"(?s)^(.*?){EPISODE_NUMBER}", "$1")
    return F.regexp_replace(rest, rf"^{DATE_MARKS}+|{DATE_MARKS}+$", "")


def one_line(text: Column) -> Column:
    """White space runs made one space, ends trimmed."""
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))
