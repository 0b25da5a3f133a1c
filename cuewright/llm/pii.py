"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Every pattern takes time in proportion to the text, unbroken runs of letters or digits included: a proposal is
anchored where a run begins or at the one sign that it must hold, and runs are never given back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_text, fresh

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
#: Characters on each side of a span in which context words count.
WINDOW = 48


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others, doubling every second one from the right."""
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an international account number leaves 1 when divided by 97, its first four signs moved to the end."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


#: Signs in the account numbers of each country.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_SIGNS_OF = {country: n for n, countries in IBAN_SIGNS.items() for country in countries.split()}


def account_length(proposal: str) -> int:
    """Characters of the account number that a proposal begins with (0: none), which ends where the proposal or a group ends.

    The length of the country comes first, then any other from the longest.
    """
    ends = [i for i in range(1, len(proposal) + 1) if proposal[i - 1] != " " and (i == len(proposal) or proposal[i] == " ")]
    lengths = [(len(proposal[:i].replace(" ", "")), i) for i in reversed(ends)]
    lengths.sort(key=lambda x: x[0] != _SIGNS_OF.get(proposal[:2]))
    return next((i for n, i in lengths if 15 <= n <= 34 and mod97(proposal[:i].replace(" ", ""))), 0)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


@dataclass(frozen=True)
class Rule:
    """base: the spans stay whatever their score; others need a score of `least`.

    propose: spans of a text that may be meant, leftmost first and without overlaps. context raises, against lowers the score.
    """

    kind: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    needs: str
    valid: Callable[[str], bool]
    score: float
    context: frozenset[str]
    against: frozenset[str]
    base: bool = True
    least: float = 0.0

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        return ((a, b) for a, b in self.propose(text) if self.valid(text[a:b]))


def _matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from their sign outwards: the run before it, no further than the last one's end, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        # Each stretch between two signs is turned and searched once.
        before = text[done:at][::-1]
        gap = _NOT_LOCAL.search(before)
        start = at - (gap.start() if gap else len(before))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """What follows an account number within its proposal, or a proposal of none but for its first sign, is searched again."""
    at = 0
    while m := _ACCOUNT.search(text, at):
        n = account_length(m[0])
        at = m.start() + (n or 1)
        if n:
            yield m.start(), at


def _words(*words: str) -> frozenset[str]:
    return frozenset(" ".join(words).split())


_WORD = re.compile(r"\w+")


def _always(found: str) -> bool:
    return True


def _is_address(found: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


#: Context words are English, German, French and Spanish.
RULES = (
    Rule("email", _emails, "@", _always, 0.9, _words("mail email contact write", "kontakt schreiben schreib", "courriel contacter écrire écrivez", "correo contacto escriba escribe"), _words("noreply")),
    Rule("ip", _matches(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), ".", _is_address, 0.6, _words("ip address host server from login", "adresse rechner anmeldung", "adresse serveur hôte connexion", "dirección servidor equipo acceso"), _words("version release section chapter kapitel abschnitt chapitre versión capítulo")),
    Rule("card", _matches(r"[0-9](?:[ -]?[0-9])++"), "", lambda m: 14 <= len(d := _digits(m)) <= 19 and luhn(d), 0.8, _words("card visa mastercard amex credit payment pay", "karte kreditkarte kartennummer zahlung", "carte bancaire paiement crédit", "tarjeta crédito pago"), _words("isbn tracking serial seriennummer")),
    Rule("phone", _matches(r"\+[0-9][ ().0-9-]+[0-9]"), "+", lambda m: 10 <= len(_digits(m)) <= 15, 0.7, _words("phone tel call mobile fax", "telefon anrufen handy rufnummer", "téléphone appeler appelez portable", "teléfono llamar llame móvil"), _words("isbn tracking serial seriennummer")),
    Rule("iban", _accounts, "", _always, 0.9, _words("iban account bank transfer", "konto überweisung kontonummer", "compte banque virement", "cuenta banco transferencia"), _words("serial serie série"), base=False, least=0.65),
    Rule("ssn", _matches(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), "-", _always, 0.4, _words("ssn social security"), _words("phone tel fax isbn"), base=False, least=0.6),
)
ORDER = {r.kind: i for i, r in enumerate(RULES)}
_ANY = re.compile("[@0-9]")


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int, float, bool]]:
    """Spans (kind, start, end, score, base) of one whole text in code points, by start, then kind as listed."""
    found = []
    if not _ANY.search(text):
        return found
    for rule in rules:
        if rule.needs not in text:
            continue
        for a, b in rule.spans(text):
            around = _WORD.findall(f"{text[max(0, a - WINDOW) : a]} {text[b : b + WINDOW]}".lower())
            score = rule.score + 0.25 * (not rule.context.isdisjoint(around)) - 0.2 * (not rule.against.isdisjoint(around))
            score = round(min(1.0, max(0.0, score)), 6)
            if rule.base or score >= rule.least:
                found.append((rule.kind, a, b, score, rule.base))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def find_pii(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """df with the personal data of each whole text as an array of (kind, start, end, score, base).

    Base kinds are found leftmost and without overlaps within a kind; spans of different kinds may overlap.
    Null and empty texts give empty arrays; a text is read in one pass, however long its unbroken runs are. A column named like out is replaced; rows and ties are kept.
    """

    def setup():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            names = ("kind", "start", "end", "score", "base")
            return [pa.array([[dict(zip(names, s)) for s in find(as_text(t))] for t in texts], ARROW_SPAN)]

        return compute

    return append_columns(df, text_col, [T.StructField(out, SPAN)], setup)


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    out, reach = [], 0
    for kind, a, b, _, _ in find(text):
        if a >= reach:
            out += [text[reach:a], f"<{kind}>"]
        reach = max(reach, b)
    return "".join([*out, text[reach:]])


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with personal data in text_col replaced by its kind; nulls stay null, all rows and columns stay."""
    order = df.columns
    was_null, redacted = fresh(df, "was_null"), fresh(df, "redacted")
    marked = df.withColumn(was_null, F.col(text_col).isNull())

    def setup():
        return lambda texts: [pa.array([redact(as_text(t)) for t in texts], pa.string())]

    done = append_columns(marked, text_col, [T.StructField(redacted, T.StringType())], setup)
    done = done.withColumn(text_col, F.when(~F.col(was_null), F.col(redacted)))
    return done.select(*order)
