"""Name similarity: Jaro-Winkler over names as written and with the first name's long form."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Short forms of given names, and the name that each stands for.
LONG_FORM = {
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "robby": "robert", "bert": "robert",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "willie": "william", "liam": "william",
    "mike": "michael", "mikey": "michael", "mick": "michael", "mickey": "michael",
    "jim": "james", "jimmy": "james", "jamie": "james",
    "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard", "richie": "richard",
    "jack": "john", "johnny": "john", "jon": "john",
    "joe": "joseph", "joey": "joseph",
    "tom": "thomas", "tommy": "thomas",
    "dave": "david",
    "dan": "daniel", "danny": "daniel",
    "ed": "edward", "eddie": "edward", "ted": "edward", "teddy": "edward", "ned": "edward",
    "steve": "stephen", "stevie": "stephen",
    "chris": "christopher",
    "matt": "matthew", "matty": "matthew",
    "tony": "anthony",
    "andy": "andrew", "drew": "andrew",
    "alex": "alexander",
    "al": "albert",
    "ben": "benjamin", "benny": "benjamin",
    "charlie": "charles", "chuck": "charles", "charley": "charles",
    "fred": "frederick", "freddy": "frederick",
    "frank": "francis", "frankie": "francis",
    "hank": "henry", "harry": "henry", "hal": "henry",
    "jerry": "gerald", "gerry": "gerald",
    "larry": "lawrence",
    "lenny": "leonard", "leo": "leonard",
    "nick": "nicholas", "nicky": "nicholas",
    "pat": "patrick", "paddy": "patrick",
    "pete": "peter", "petey": "peter",
    "phil": "philip",
    "ray": "raymond",
    "sam": "samuel", "sammy": "samuel",
    "walt": "walter", "wally": "walter",
    "ken": "kenneth", "kenny": "kenneth",
    "ron": "ronald", "ronny": "ronald", "ronnie": "ronald",
    "don": "donald", "donny": "donald", "donnie": "donald",
    "greg": "gregory",
    "doug": "douglas", "dougie": "douglas",
    "liz": "elizabeth", "lizzy": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "eliza": "elizabeth",
    "kate": "katherine", "katie": "katherine", "kathy": "katherine", "cathy": "katherine",
    "jen": "jennifer", "jenny": "jennifer",
    "sue": "susan", "susie": "susan", "suzy": "susan",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "madge": "margaret",
    "barb": "barbara",
    "debbie": "deborah", "deb": "deborah",
    "cindy": "cynthia",
    "vicky": "victoria", "tori": "victoria",
    "becky": "rebecca", "becca": "rebecca",
    "pam": "pamela",
    "sandy": "sandra",
    "mandy": "amanda",
    "abby": "abigail",
    "gabby": "gabrielle", "gabi": "gabrielle",
    "steph": "stephanie",
    "nicki": "nicole",
}


def jaro_winkler(a: bytes, b: bytes) -> float:
    """On bytes, with floored transpositions; the prefix (up to 4, weight 0.1) counts above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    m, swapped = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((n for n in range(min(4, len(a), len(b))) if a[n] != b[n]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def long_form(full: str) -> str:
    first, _, rest = full.partition(" ")
    return f"{LONG_FORM.get(first, first)} {rest}" if rest else LONG_FORM.get(first, first)


@lru_cache(maxsize=1 << 16)
def similarity(a: str, b: str) -> float:
    return max(jaro_winkler(a.encode(), b.encode()), jaro_winkler(long_form(a).encode(), long_form(b).encode()))


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of a batch is compared once."""
    both = pd.MultiIndex.from_arrays([a, b])
    codes, kinds = both.factorize()
    return pd.Series([similarity(x, y) for x, y in kinds]).take(codes).reset_index(drop=True) if len(both) else pd.Series([], dtype="float64")


def similarities(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``similarity`` of ``texts[a]`` and ``texts[b]``, many pairs at once; the same numbers to the last bit."""
    out = np.ones(len(a))
    differ = np.nonzero(a != b)[0]
    if not len(differ):
        return out
    used, at = np.unique(np.concatenate([a[differ], b[differ]]), return_inverse=True)
    names = [texts[i] for i in used]
    plain, long = [t.encode() for t in names], [long_form(t).encode() for t in names]
    short = np.array([0 < len(p) <= 64 and 0 < len(q) <= 64 for p, q in zip(plain, long, strict=True)])
    x, y = at[: len(differ)], at[len(differ) :]
    fast = short[x] & short[y]
    for k in np.nonzero(~fast)[0]:
        out[differ[k]] = similarity(names[x[k]], names[y[k]])
    if fast.any():
        x, y, to = x[fast], y[fast], differ[fast]
        tables = [_Names([p if s else b"" for p, s in zip(form, short, strict=True)]) for form in (plain, long)]
        for i in range(0, len(to), 1 << 15):
            part = slice(i, i + (1 << 15))
            out[to[part]] = np.maximum(*(t.jaro_winkler(x[part], y[part]) for t in tables))
    return out


class _Names:
    """Names of 1 to 64 bytes, with the places of each byte in them as bits of a word."""

    def __init__(self, names: list[bytes]) -> None:
        self.size = np.array([len(n) for n in names], np.int64)
        self.kind = np.unique(np.array(names, object), return_inverse=True)[1]
        wide = max(1, int(self.size.max()))
        self.bytes = np.zeros((len(names), wide), np.uint8)
        for i, n in enumerate(names):
            self.bytes[i, : len(n)] = np.frombuffer(n, np.uint8)
        seen = np.zeros(256, bool)
        seen[self.bytes] = True
        letter = np.cumsum(seen) - 1
        self.letters = letter[self.bytes]
        self.places = np.zeros((len(names), int(seen.sum())), np.uint64)
        for j in range(wide):
            on = np.nonzero(self.size > j)[0]
            self.places[on, self.letters[on, j]] |= np.uint64(1 << j)

    def jaro_winkler(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = self.size[a], self.size[b]
        reach = np.maximum(la, lb) // 2 - 1
        every = _low(lb)
        free, left = every.copy(), np.zeros(len(a), np.uint64)
        for i in range(int(la.max())):
            window = _low(np.minimum(np.maximum(i + reach + 1, 0), 64)) & ~_low(np.maximum(i - reach, 0))
            found = self.places[b, self.letters[a, i]] & free & window
            found = np.where(i < la, found, np.uint64(0))
            first = found & (~found + np.uint64(1))
            free ^= first
            left |= np.where(first > 0, np.uint64(1 << i), np.uint64(0))
        right = every & ~free
        m = np.bitwise_count(left).astype(np.int64)
        moved = np.zeros(len(a), np.int64)
        one = np.uint64(1)
        for _ in range(int(m.max())):
            x, y = left & (~left + one), right & (~right + one)
            on = x > 0
            i, j = (np.where(on, np.bitwise_count(v - one), 0).astype(np.int64) for v in (x, y))
            moved += on & (self.bytes[a, i] != self.bytes[b, j])
            left ^= x
            right ^= y
        swapped = moved // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m > 0, (m / la + m / lb + (m - swapped) / m) / 3, 0.0)
        wide = min(4, self.bytes.shape[1])
        alike = np.cumprod(self.bytes[a, :wide] == self.bytes[b, :wide], axis=1).sum(axis=1)
        prefix = np.minimum(alike, np.minimum(la, lb))
        score = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
        return np.where(self.kind[a] == self.kind[b], 1.0, score)


def _low(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` bits set, up to 64."""
    n = n.astype(np.uint64)
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))
