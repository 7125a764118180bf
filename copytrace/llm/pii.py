"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs,
digits, URL schemes and identifier cues. From each anchor a deterministic
parser expands to the left and right, reading every character a bounded number
of times, and validates what it has found.

Base kinds, leftmost and non-overlapping within a kind; a match that fails its
validation is dropped without a retry:
- email: local part, at-sign, at least two dot-separated labels;
- ip: four dot-separated numbers, each at most 255;
- card: digits with at most one space or hyphen between, 14 to 19 digits, Luhn;
- phone: plus sign and 10 to 15 digits with spaces, dots, hyphens, brackets.

Further kinds: login (user name in a URL), secret (value after a cue such as
"password=", or an access key id), iban (after its cue, cut at its country's
length, mod 97), ssn (after its cue). Cues count in any case of A-Z. They are
added, base spans stay.

Spans are (kind, start, stop) in code points, stop exclusive, by start, then by
kind in the order above.

Defined cases: a null text counts as empty and has no spans; equal rows and
rows sharing an id each get their row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from copytrace.llm.common import documents, spread, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "secret", "iban", "ssn")

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALNUM = _LETTERS | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_SCHEME = _ALNUM | frozenset("+.-")
_SECRET = _ALNUM | frozenset("_+/.-")
_KEY_ID = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_AUTHORITY_END = frozenset(" \t\n\x0b\x0c\r/?#\"'<>")
# Cue words and the prefixes of access key ids.
_SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key")
_KEY_PREFIXES = ("AKIA", "ASIA")
# ASCII only, so that places stay the same.
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_LEAD = frozenset(" :#=\"'")
# Length of an IBAN by country.
_IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
        "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
        "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
        "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}


def _run(text: str, at: int, of: frozenset) -> int:
    """End of the run of ``of`` that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in of:
        at += 1
    return at


def _luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


class Finder:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        words = {"@": "at", "+": "plus", "://": "scheme", **dict.fromkeys("0123456789", "digit")}
        words |= dict.fromkeys(_KEY_PREFIXES, "key")
        self.cues = ahocorasick.Automaton()
        for kind, cues in (("secret", _SECRET_CUES), ("iban", ("iban",)), ("ssn", ("ssn", "social security number"))):
            for cue in cues:
                self.cues.add_word(cue, kind)
        for word, kind in words.items():
            self.anchors.add_word(word, kind)
        self.anchors.make_automaton()
        self.cues.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, stop), sorted."""
        found: set[tuple[int, int, int]] = set()
        email_from = ip_from = card_from = 0
        for end, anchor in self.anchors.iter(text):
            if anchor == "digit":
                if end >= card_from:
                    card_from = self._card(text, end, found)
                if end >= ip_from:
                    ip_from = self._ip(text, end, found)
            elif anchor == "at":
                email_from = self._email(text, end, email_from, found)
            elif anchor == "plus":
                self._phone(text, end, found)
            else:
                getattr(self, f"_{anchor}")(text, end + 1, found)
        for end, cue in self.cues.iter(text.translate(_FOLD)):
            getattr(self, f"_{cue}")(text, end + 1, found)
        return sorted(found)

    def _card(self, text: str, at: int, found: set) -> int:
        """Reads a chain of digits; returns where the next one may start."""
        stop, n = _run(text, at, _DIGITS), len(text)
        digits = [text[at:stop]]
        while stop + 1 < n and text[stop] in " -" and text[stop + 1] in _DIGITS:
            more = _run(text, stop + 1, _DIGITS)
            digits.append(text[stop + 1 : more])
            stop = more
        number = "".join(digits)
        if 14 <= len(number) <= 19 and _luhn(number):
            found.add((at, KINDS.index("card"), stop))
        return stop

    def _ip(self, text: str, at: int, found: set) -> int:
        stop = _run(text, at, _DIGITS)
        parts = [text[at:stop]]
        while len(parts) < 4 and text[stop : stop + 1] == "." and text[stop + 1 : stop + 2] in _DIGITS:
            more = _run(text, stop + 1, _DIGITS)
            parts.append(text[stop + 1 : more])
            stop = more
        if len(parts) == 4 and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts):
            found.add((at, KINDS.index("ip"), stop))
        return stop

    def _email(self, text: str, at: int, first: int, found: set) -> int:
        start = at
        while start > first and text[start - 1] in _LOCAL:
            start -= 1
        stop = _run(text, at + 1, _LABEL)
        if start == at or stop == at + 1:
            return first
        labels = 1
        while text[stop : stop + 1] == "." and (more := _run(text, stop + 1, _LABEL)) > stop + 1:
            stop, labels = more, labels + 1
        if labels == 1:
            return first
        found.add((start, KINDS.index("email"), stop))
        return stop

    def _phone(self, text: str, at: int, found: set) -> None:
        if text[at + 1 : at + 2] not in _DIGITS:
            return
        stop = _run(text, at + 2, _PHONE)
        while text[stop - 1] not in _DIGITS:
            stop -= 1
        if stop >= at + 4 and 10 <= sum(c in _DIGITS for c in text[at:stop]) <= 15:
            found.add((at, KINDS.index("phone"), stop))

    def _scheme(self, text: str, at: int, found: set) -> None:
        start, stop = at - 3, at
        while start > 0 and text[start - 1] in _SCHEME:
            start -= 1
        while stop < len(text) and text[stop] not in _AUTHORITY_END:
            stop += 1
        user, sign, host = text[at:stop].rpartition("@")
        if start < at - 3 and sign and user and host:
            found.add((start, KINDS.index("login"), stop))

    def _value(self, text: str, at: int, marks: str) -> int:
        """Start of the value after a cue, perhaps quoted: one of ``marks`` between up to two spaces each, perhaps a quote."""
        at += text[at : at + 1] in ('"', "'")
        for _ in range(2):
            at += text[at : at + 1] == " "
        if text[at : at + 1] not in marks or at >= len(text):
            return -1
        at += 1
        for _ in range(2):
            at += text[at : at + 1] == " "
        return at + (text[at : at + 1] in ('"', "'"))

    def _secret(self, text: str, at: int, found: set) -> None:
        start = self._value(text, at, "=:")
        if start < 0:
            return
        stop = _run(text, start, _SECRET)
        if stop - start >= 8 and any(c in _DIGITS for c in text[start:stop]):
            found.add((start, KINDS.index("secret"), stop))

    def _key(self, text: str, at: int, found: set) -> None:
        start, stop = at - 4, _run(text, at, _KEY_ID)
        if stop - start == 20 and text[stop : stop + 1] not in _LETTERS and (start == 0 or text[start - 1] not in _ALNUM):
            found.add((start, KINDS.index("secret"), stop))

    def _iban(self, text: str, at: int, found: set) -> None:
        while text[at : at + 1] in _LEAD:
            at += 1
        stop, code, known = at, "", (-1, "")
        length = _IBAN_LENGTHS.get(text[at : at + 2].upper())
        while stop < len(text) and len(code) < 34 and (text[stop] in _ALNUM or text[stop] == " " and text[stop + 1 : stop + 2] in _KEY_ID):
            code += text[stop].strip()
            stop += 1
            if len(code) == length and known[0] < 0 and (stop == len(text) or text[stop] not in _ALNUM):
                known = stop, code
        for stop, code in (known, (stop, code)):
            if 15 <= len(code) and code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                found.add((at, KINDS.index("iban"), stop))
                break

    def _ssn(self, text: str, at: int, found: set) -> None:
        while text[at : at + 1] in _LEAD:
            at += 1
        area, group, serial = text[at : at + 3], text[at + 4 : at + 6], text[at + 7 : at + 11]
        shaped = text[at + 3 : at + 4] == text[at + 6 : at + 7] == "-" and len(serial) == 4 and _DIGITS.issuperset(area + group + serial)
        if shaped and text[at + 11 : at + 12] not in _DIGITS and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            found.add((at, KINDS.index("ssn"), at + 11))


_FINDER: list[Finder] = []


def finder() -> Finder:
    """One automaton per process."""
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


@F.pandas_udf(ArrayType(StringType()))
def _spans(texts: pd.Series) -> pd.Series:
    find = finder().spans
    return pd.Series([[f"{KINDS[k]}:{a}:{b}" for a, k, b in find(t)] for t in texts])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans as array of (kind, start, stop)."""
    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    found = source.select("id", _spans(text_of("text")).alias("spans"))

    def parts(x: Column) -> Column:
        of = F.split(x, ":")
        return F.struct(of[0].alias("kind"), of[1].cast("long").alias("start"), of[2].cast("long").alias("stop"))

    return found.select("id", F.transform("spans", parts).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, counts per base kind, base_sha256 and spans of every document."""
    found = find_pii(documents(spark, folder).select("doc_id", "text"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
