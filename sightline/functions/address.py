r"""Addresses in canonical form, and their parts.

An address is read as a sequence of words by a small grammar, tried in this order at each word:

    unit      = unit-name value     корпус 2, лит. А: the name in full, then the value
    house     = number letter       12 а, apart by spaces alone or by marks: one word
    noise     = stop word | postcode of six digits: left out
    anything else: the word itself

where a value is a number, perhaps with a letter, or a single letter after a name that may have one. A slash between a
house number and another number stands for корпус; after anything else it only parts words. A г after a house number is its letter where only spaces part them, else it stands for город.
Then street names are told in one form (the longest spelling first).

Each distinct address is read once. Nulls and empty texts have an empty form and no parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Words that say nothing about the place, and short forms of unit kinds.
STOP = frozenset("россия рф волгоградская область обл город г волгоград улица ул проспект просп пр кт имени им".split())
UNITS = {"к": "корпус", "корп": "корпус", "корпус": "корпус", "стр": "строение", "строение": "строение", "лит": "литера", "литера": "литера", "влад": "владение", "владение": "владение", "соор": "сооружение", "сооружение": "сооружение"}
KINDS = ("корпус", "строение", "литера", "владение", "сооружение")
LETTERED = ("корпус", "строение", "литера")
STREETS = {"маршала жукова": ["маршала советского союза к жукова"]}

LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяabcdefghijklmnopqrstuvwxyz"

#: A word, with what stands between it and the one before.
WORD = re.compile(r"(?P<gap>[\W_]*)(?P<word>[^\W_]+)")


def words(text: str) -> Iterator[tuple[str, str]]:
    """(gap, word) of a text: compatibility composition, lower case, ё as е."""
    for found in WORD.finditer(unicodedata.normalize("NFKC", text).lower().replace("ё", "е")):
        yield found["gap"], found["word"]


def numbered(word: str) -> bool:
    """A number of any length, perhaps with one letter."""
    return word[:1].isdigit() and (word.isdigit() or (word[:-1].isdigit() and word[-1].isalpha()))


def lettered(word: str) -> bool:
    return len(word) == 1 and word.isalpha()


def parsed(text: str) -> Iterator[str]:
    """The words of an address by the grammar."""
    left, number = list(words(text))[::-1], False
    while left:
        gap, word = left.pop()
        after, then = (left[-k] if len(left) >= k else ("", "") for k in (1, 2))
        if number and gap.strip() == "/" and numbered(word):
            yield from ("корпус", word)
            number = False
            continue
        # What a slash after it may divide: a house number, which has four digits at most.
        number = numbered(word) and len(word.rstrip(LETTERS)) <= 4
        kind = UNITS.get(word)
        if kind and (numbered(after[1]) or (word != "к" and kind in LETTERED and lettered(after[1]))):
            yield kind
            value = left.pop()[1]
            number = numbered(value) and len(value.rstrip(LETTERS)) <= 4
            yield value
        elif word.isdigit() and len(word) == 6:
            continue
        elif word.isdigit() and lettered(after[1]) and not after[0].strip(" \t.,;" if after[1] != "г" else " ") and not (after[1] in UNITS and numbered(then[1])):
            left.pop()
            number = False
            yield word + after[1]
        elif word not in STOP:
            yield word


def renamed(address: str, streets: dict[str, list[str]]) -> str:
    """Spellings of street names in the form of the dictionary, the longest first."""
    told = {" ".join(w for _, w in words(spelling)): " ".join(w for _, w in words(name)) for name, spellings in streets.items() for spelling in (name, *spellings)}
    told.pop("", None)
    if not told:
        return address
    any_of = "|".join(re.escape(x) for x in sorted(told, key=lambda x: (-x.count(" "), x)))
    return re.sub(rf"(?<!\S)(?:{any_of})(?!\S)", lambda found: told[found[0]], address)


def normal_address(value: str | None, streets: dict[str, list[str]] | None = None) -> str:
    """An address in canonical form."""
    return renamed(renamed(" ".join(parsed(value or "")), STREETS), streets or {})


def address_parts(address: str) -> tuple[str | None, dict[str, str]]:
    """(house, units) of a canonical address: its last number outside the units, and the value of each kind of unit."""
    house, units, name = None, {}, None
    for word in address.split():
        if name and (numbered(word) or (name in LETTERED and lettered(word))):
            units[name] = word
        elif numbered(word) and not name:
            house = word
        name = word if word in KINDS else None
    return house, units


def with_address(rows: DataFrame, column: str = "address", streets: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with norm, house and units (map) of the address; each distinct address is worked on once."""

    def run(frames):
        for pdf in frames:
            norm = [normal_address(a, streets) for a in pdf["__address"]]
            parts = [address_parts(n) for n in norm]
            yield pd.DataFrame({"__address": pdf["__address"], "norm": norm, "house": [p[0] for p in parts], "units": [p[1] for p in parts]})

    distinct = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("__address")).distinct()
    done = distinct.mapInPandas(run, "__address string, norm string, house string, units map<string,string>")
    return rows.join(done, F.col(column) == F.col("__address"), "left").drop("__address")
