"""Operator 3, personal data: span generators, gradient-boosted trees, calibrated redaction.

High-recall generators propose overlapping spans of several kinds. The four
base kinds (email, ip, card, phone) have exact rules and are always kept. The
other proposals (bank accounts, identity numbers, shorter card numbers, national
phone numbers, written-out mail addresses, network addresses, dates of birth)
are scored by boosted regression trees over the format of the span, checks that
its kind has (check digits, ranges) and the words around it in four languages; a
span is kept if its score reaches its kind's threshold, which is calibrated to
``precision`` on sentences that training did not see. Trees and thresholds are
trained here, on ``examples`` labelled spans drawn from the sentences below with
a fixed seed: a label says what the sentence calls the span, or, where the
format alone tells, whether it is valid. Kept spans that overlap a base span or
a better one are dropped.

Defined results: a null text counts as empty; very long texts are read whole,
in time linear in their length; repeated rows get equal results; an empty table
gives no row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from eddyflow.llm.common import slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "national_id", "card_short", "phone_local", "email_masked", "ipv6", "mac", "birth_date")
KINDS = BASE + ADDED

# Fixed formats of the base kinds; each is written so that one pass is linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Fixed formats of the proposals.
AT, DOT = r"(?:at|AT|arobase|arroba|ät)", r"(?:dot|DOT|punkt|point|punto)"
PROPOSALS = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])(?:[XYZ]-?[0-9]{7}|[0-9]{8})-?[A-Z](?![\w-])|(?<![\w-])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![\w-])"),
    "card_short": re.compile(r"(?<![\w.,+-])[0-9](?:[ -]?[0-9]){12,14}(?![\w-])"),
    "phone_local": re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{0,2}[0-9]{2,4}){2,4}(?![\w-])"),
    "email_masked": re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]{{1,64}}(?: ?[\[({{<] ?{AT} ?[\])}}>] ?[A-Za-z0-9-]{{1,63}}(?: ?[\[({{<] ?{DOT} ?[\])}}>] ?[A-Za-z0-9-]{{1,24}}| {DOT} [A-Za-z0-9-]{{1,24}}|\.[A-Za-z0-9-]{{1,24}}){{1,4}}| {AT} [A-Za-z0-9-]{{1,63}}(?: {DOT} [A-Za-z0-9-]{{1,24}}){{1,4}})(?!\w)"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "mac": re.compile(r"(?<![\w:.-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-])"),
    "birth_date": re.compile(r"(?<![\w/.-])[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4}(?![\w/-])"),
}
#: A proposal can only be where its sign is; texts without it are not searched for the kind.
SIGNS = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "ssn": re.compile(r"[0-9]{3}[- ][0-9]{2}[- ]"), "national_id": re.compile(r"[0-9]{7}-?[A-Z]|[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3}"), "card_short": re.compile(r"[0-9](?:[ -]?[0-9]){12}"), "phone_local": None,
    "email_masked": re.compile(rf"[\[({{<] ?{AT} ?[\])}}>]| {AT} [A-Za-z0-9-]+ {DOT} "), "ipv6": re.compile(r":[0-9A-Fa-f]{0,4}:"), "mac": re.compile(r"[0-9A-Fa-f][:-][0-9A-Fa-f]{2}[:-]"), "birth_date": re.compile(r"[0-9][/.-][0-9]"),
}
# Fixed stems of words that speak for a kind, in four languages, and of words that speak of other numbers.
CUES = {
    "iban": "iban account bank konto compte cuenta virement transfer überweis transferencia rib", "ssn": "ssn social security insurance sozial sécurité seguridad", "national_id": "dni nie nif identity identidad ausweis identité passport reisepass pasaporte sécurité",
    "card_short": "card amex visa karte carte tarjeta credit kredit charge", "phone_local": "phone tel call mobile fax cell ring reach number text telefon handy anruf nummer ruf erreich téléphone portable appel joindre numéro móvil llam teléfono whatsapp sms",
    "email_masked": "mail contact write reach schreib kontakt écri correo escrib", "ipv6": "ip ipv6 host address server client adresse dirección connect verbind conn route", "mac": "mac device adapter hardware gerät appareil dispositivo adresse dirección ethernet wlan wifi router",
    "birth_date": "born birth dob birthday birthdate geboren geburt geb naissance né nacid nacim nació cumple anniversaire",
}
AGAINST = "order invoice version page price total isbn part release chapter score line figure item published updated bestell rechnung seite preis artikel teil commande facture prix article pedido factura página precio artículo serial sku batch lot modified erschien publi ticket ref case room deadline meeting frist delivery liefer livraison entrega"
# Fixed endings of mail domains.
ENDINGS = frozenset("com org net edu gov info biz io co de fr es uk us eu ch at it nl be pl pt".split())
STEMS = {k: re.compile(rf"(?<!\w)(?:{'|'.join(v.split())})") for k, v in (CUES | {"against": AGAINST}).items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact rules: leftmost non-overlapping matches of each kind, those that fail its test dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans of the added kinds: everything that may be personal data by its form."""
    return [(kind, *m.span()) for kind, p in PROPOSALS.items() if SIGNS[kind] is None or SIGNS[kind].search(text) for m in p.finditer(text)]


def near(stems: re.Pattern[str], before: str) -> float:
    """How near the last word of these stems stands: 1 beside the span, 0 where there is none."""
    at = max((m.end() for m in stems.finditer(before)), default=None)
    return 0.0 if at is None else 1 / (1 + (len(before) - at) / 8)


def checked(kind: str, span: str, digits: list[str], groups: list[str], nums: list[int]) -> float:
    """Whether the span passes the test that its kind has: check digits, ranges, known endings."""
    if kind == "iban":
        s = re.sub(r"\W", "", span)
        return float(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)
    if kind == "ssn":
        return float(nums[0] not in (0, 666) and nums[0] < 900 and nums[1] > 0 and nums[2] > 0)
    if kind == "national_id":
        s = re.sub(r"\W", "", span)
        if s[-1].isalpha():
            return float("TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == s[-1])
        return float(97 - int(s[:13]) % 97 == int(s[13:]))
    if kind == "card_short":
        return float(luhn("".join(digits)))
    if kind == "birth_date":
        return float(len(nums) == 3 and sum(1900 <= y <= 2020 for y in nums) == 1 and sorted(nums)[0] in range(1, 13) and 1 <= sorted(nums)[1] <= 31)
    if kind == "phone_local":
        return float(9 <= len(digits) <= 11)
    if kind == "email_masked":
        return float(groups[-1].lower() in ENDINGS)
    if kind == "ipv6":
        try:
            return float(bool(ipaddress.IPv6Address(span)))
        except ValueError:
            return 0.0
    return float(len({*span.lower()} - {*":-"}) > 2)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span as numbers."""
    span, before, after = text[start:end], text[max(0, start - 60) : start].lower(), text[end : end + 30].lower()
    digits = [c for c in span if "0" <= c <= "9"]
    groups = [x for x in re.split(r"[^0-9A-Za-z]+", span) if x]
    nums = [int(x) for x in groups if x.isascii() and x.isdigit() and len(x) < 6]
    cue, against = near(STEMS[kind], before), near(STEMS["against"], before)
    return [
        float(KINDS.index(kind)), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[0]) if groups else 0,
        len({*span} - {*"0123456789"}), len({*digits}) / max(len(digits), 1), float("(" in span), float(" " in span), float("-" in span), float("." in span), float("/" in span), float("::" in span),
        float(span[:1] == "0"), float(any(c.isalpha() for c in span)), checked(kind, span, digits, groups, nums), cue, float(bool(STEMS[kind].search(after))), against, cue - against,
        float(before.endswith(("#", "$", "€", "£", "no. ", "nr. ", "v"))), float(before.rstrip().endswith(":")), float(after[:1].isalnum() or after[:1] in "%€$"), float(bool(re.match(r"\s?(?:€|eur|usd|kg|km|cm|mm|ml|%|\$)", after))),
    ]


# ---------------------------------------------------------------- boosted trees
@dataclass
class Trees:
    """Boosted trees of fixed depth: for every tree the split features, thresholds and leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    limits: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(v)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            z += v[node - len(f)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; splits at quantiles of each feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z, fs, ts, vs = np.full(len(x), start), [], [], []
    gain_of = lambda g, h: g * g / (h + l2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        f, t, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(len(x), np.int64)
        for k in range(2**depth - 1):
            at = np.flatnonzero(node == k)
            best = 1e-6
            for j, cut in enumerate(cuts):
                if len(at) and len(cut):
                    b = np.searchsorted(cut, x[at, j], "left")
                    gl, hl = np.cumsum(np.bincount(b, g[at], len(cut) + 1))[:-1], np.cumsum(np.bincount(b, h[at], len(cut) + 1))[:-1]
                    gain = gain_of(gl, hl) + gain_of(g[at].sum() - gl, h[at].sum() - hl) - gain_of(g[at].sum(), h[at].sum())
                    if gain.max() > best:
                        best, f[k], t[k] = gain.max(), j, cut[int(gain.argmax())]
            node[at] = 2 * k + 1 + (x[at, f[k]] > t[k])
        leaf = node - len(f)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        z += v[leaf]
        fs.append(f), ts.append(t), vs.append(v)
    return Trees(np.array(fs), np.array(ts), np.array(vs), start, {})


# Sentences for training, {} where the span stands: those that speak of the kind, and those of other things.
PERSONAL = {
    "iban": ("please transfer the rent to {} by friday", "my bank details are {}", "unser Konto lautet {}", "Überweisen Sie bitte auf {}", "voici mon RIB : {}", "virement sur le compte {}", "ingresa el pago en la cuenta {}", "mi IBAN es {}", "{}", "refunds go to {} within a week"),
    "ssn": ("her social security number is {}", "SSN: {}", "SSN {} was on the form", "applicant's social security no. {}", "verify the last digits of social security {}", "Sozialversicherung {}", "numéro de sécurité sociale {}", "seguridad social {}", "{} is his social security number", "he gave {} as social security no.", "{} (SSN)", "{} on the insurance card"),
    "national_id": ("con DNI {}", "mi NIE es {}", "identity card {}", "Ausweis Nr. {}", "carte d'identité {}", "titular con NIF {}", "sécurité sociale : {}", "{}", "passport or identity number {}", "firmado, {}"),
    "card_short": ("charge my amex {}", "card number {}", "credit card: {}", "Kreditkarte {}", "Karte Nr. {} gesperrt", "carte bancaire {}", "paga con la tarjeta {}", "my visa is {} and expires soon", "{} is my card number", "{} (credit card)"),
    "phone_local": ("call me at {}", "phone: {}", "you can reach her on {}", "my cell is {}", "Telefon {}", "Ruf mich unter {} an", "meine Handynummer ist {}", "Tel. {}", "appelez le {}", "mon portable : {}", "tél. {}", "llámame al {}", "mi móvil es {}", "teléfono {}", "text {} if you are late", "fax {}", "her number is {}", "erreichbar unter {}", "me joindre au {}", "whatsapp {}", "{} is her mobile", "{} (phone)", "{} is my number"),
    "email_masked": ("mail me: {}", "contact {} for details", "write to {}", "schreib an {}", "Kontakt {}", "écrivez à {}", "mon adresse {}", "escribe a {}", "correo: {}", "{}", "questions go to {} please", "posted by {}"),
    "ipv6": ("connected from {}", "the server answers on {}", "client {} logged in", "host {}", "IP-Adresse {}", "Verbindung von {}", "adresse IP {}", "connexion depuis {}", "la dirección {}", "{}", "ping {}", "user session opened by {}"),
    "mac": ("device {} joined the network", "MAC address {}", "adapter {}", "Gerät {}", "MAC-Adresse {}", "adresse MAC {}", "appareil {}", "dispositivo {}", "{}", "lease for {}", "router {}", "seen {} on wlan"),
    "birth_date": ("born on {}", "date of birth: {}", "DOB {}", "her birthday is {}", "geboren am {}", "Geburtsdatum {}", "geb. {}", "né le {}", "date de naissance : {}", "nacido el {}", "fecha de nacimiento {}", "nació el {} en la ciudad", "{} is his date of birth", "{} (birthday)"),
}
OTHER = (
    "order {} was shipped", "invoice {}", "see version {} of the tool", "part {} is in stock", "the total is {}", "item {} costs less", "published {}", "last updated {}", "release {} fixes it", "ISBN {}", "chapter {}", "the score was {}", "figure {}", "Bestellung {}", "Rechnung Nr. {}", "Seite {}", "Artikel {}",
    "erschienen am {}", "commande {}", "facture {}", "l'article {}", "publié le {}", "prix {}", "pedido {}", "factura {}", "artículo {}", "publicado el {}", "precio {}", "serial {}", "ticket {}", "{} rows were read", "between {} and later", "the value {} was measured", "sequence {}", "code {} appears", "Wert {}", "valeur {}",
    "valor {}", "delivery on {}", "Frist {}", "la réunion du {}", "la entrega del {}", "meeting on {}", "archive {}", "entry {}", "lot {}", "Messung {}", "tableau {}", "room {}", "the ratio {} holds", "started {}", "case {}",
)
WORDS = "the of and we it was on for with is that this in to from by not der die und ist ein mit für auf nicht le la les et est une pour dans pas el los y es una por con que en time people place work day year haus zeit jahr tag leute maison temps gens jour casa tiempo gente día".split()


class Spans:
    """Drawn spans of each kind, valid ones and ones that only look like it."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, xs: Sequence) -> object:
        return xs[int(self.rng.integers(len(xs)))]

    def digits(self, k: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, k)))

    def hexa(self, k: int) -> str:
        return "".join(self.pick("0123456789abcdef") for _ in range(k))

    def name(self) -> str:
        return self.pick("anna john maria peter lucas sofia jean claire hans julia pablo carmen info office sales team".split()) + self.pick(["", "", ".", "_"]) + self.pick("smith meier dupont garcia lopez martin weber brown".split() + [""]).strip("._") + self.pick(["", "", self.digits(2)])

    def iban(self, good: bool) -> str:
        country, body = self.pick(["DE", "FR", "ES", "GB", "IT", "NL"]), self.digits(int(self.rng.integers(14, 22)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check if good else (check + 7) % 90 + 2:02d}{body}"
        return s if self.rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def ssn(self, good: bool) -> str:
        a, b, c = int(self.rng.integers(1, 665)), int(self.rng.integers(1, 99)), int(self.rng.integers(1, 9999))
        return f"{a:03d}-{b:02d}-{c:04d}" if good else self.pick([f"{a:03d}-{b:02d}-{c:04d}", f"000-{b:02d}-{c:04d}", f"9{self.digits(2)}-{b:02d}-{c:04d}"])

    def national_id(self, good: bool) -> str:
        if self.rng.random() < 0.4:
            s = f"{self.pick('12')}{self.digits(2)}{int(self.rng.integers(1, 13)):02d}{self.digits(8)}"
            s += f"{97 - int(s) % 97 if good else (int(s) + 5) % 90 + 1:02d}"
            return s if self.rng.random() < 0.5 else f"{s[0]} {s[1:3]} {s[3:5]} {s[5:7]} {s[7:10]} {s[10:13]} {s[13:]}"
        s = self.pick(["", "X", "Y", "Z"])
        s += self.digits(7 if s else 8)
        right = int(s.translate(str.maketrans("XYZ", "012"))) % 23
        return f"{s}{self.pick(['', '-'])}{'TRWAGMYFPDXBNJZSQVHLCKE'[right if good else (right + 1 + int(self.rng.integers(21))) % 23]}"

    def card_short(self, good: bool) -> str:
        s = self.pick(["34", "37", "4", "30", "36"]) + self.digits(12)
        s = s[: self.pick([12, 13, 14])]
        s += next(c for c in "0123456789" if luhn(s + c) == (good or self.rng.random() < 0.1))
        return s if self.rng.random() < 0.5 or len(s) != 15 else f"{s[:4]} {s[4:10]} {s[10:]}"

    def phone_local(self, good: bool) -> str:
        d = self.digits
        real = [f"({int(self.rng.integers(200, 999))}) {d(3)}-{d(4)}", f"{int(self.rng.integers(200, 999))}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{self.pick('1234567')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{self.pick('1234567')}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(2)}/{d(4)} {d(3)}", f"0{d(2)} {d(3)} {d(4)}", f"{self.pick('679')}{d(2)} {d(3)} {d(3)}", f"{self.pick('679')}{d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(9)}", f"0{d(3)}-{d(3)} {d(4)}"]
        return self.pick(real) if good else self.pick([*real, f"{d(4)}-{d(4)}", f"{d(3)}.{d(2)}.{d(2)}", d(8), f"{d(2)} {d(3)} {d(3)}", d(12), f"20{d(2)}/{d(2)}/{d(2)}", f"{d(2)} {d(2)} {d(2)}", f"{d(3)} {d(4)}", f"19{d(2)}-20{d(2)}", f"{d(2)}/{d(2)}/{d(4)}"])

    def email_masked(self, good: bool) -> str:
        at = self.pick([" [at] ", " (at) ", "[at]", "(at)", " {at} ", " at ", " (arobase) ", " [arroba] ", " arroba ", " AT "])
        dot = self.pick([" dot ", " punkt ", " punto "]) if at in (" at ", " arroba ", " AT ") else self.pick([" [dot] ", "[dot]", ".", " (punkt) ", " (dot) ", ".", " dot "])
        host, end = self.pick("example mail web firma company uni-bonn orange telefonica gmx site".split()), self.pick(["com", "org", "net", "de", "fr", "es", "co", "eu", "edu"])
        return f"{self.name()}{at}{host}{dot}{end}" if good else f"{self.pick(WORDS)}{self.pick([' (at) ', ' [at] '])}{self.pick(['config', 'line', 'offset', 'page', 'file', 'section'])}.{self.pick(['py', 'yaml', 'txt', 'md', 'json', 'log', self.digits(2)])}"

    def ipv6(self, good: bool) -> str:
        h = [self.hexa(int(self.rng.integers(1, 5))) for _ in range(8)]
        k = int(self.rng.integers(1, 6))
        d = lambda: f"{int(self.rng.integers(0, 60)):02d}"
        full = ["2001", "fe80", "2a02", "fd00"][int(self.rng.integers(4))]
        return self.pick([":".join([full, *h[1:]]), f"{full}::{':'.join(h[:k])}", f"{full}:{h[1]}:{h[2]}::{h[3]}", f"{full}::{h[5]}"]) if good else self.pick([f"{d()}:{d()}:{d()}", f"{d()}:{d()}:{d()}:{d()}", ":".join(self.digits(1) for _ in range(int(self.rng.integers(3, 6)))), f"{d()}:{d()}:{self.digits(3)}", "1::2::3"])

    def mac(self, good: bool) -> str:
        return self.pick([":", "-"]).join(self.hexa(2) for _ in range(6)).upper() if good and self.rng.random() < 0.3 else self.pick([":", "-"]).join(self.hexa(2) for _ in range(6)) if good else self.pick(["00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff", "-".join(f"{int(self.rng.integers(1, 50)):02d}" for _ in range(6))])

    def birth_date(self, good: bool) -> str:
        sep, day, month, year = self.pick("/.-"), int(self.rng.integers(1, 29)), int(self.rng.integers(1, 13)), int(self.rng.integers(1930, 2012))
        real = [f"{day:02d}{sep}{month:02d}{sep}{year}", f"{day}{sep}{month}{sep}{year}", f"{year}-{month:02d}-{day:02d}"]
        return self.pick(real) if good else self.pick([*real, f"{day:02d}{sep}{month:02d}{sep}20{int(self.rng.integers(15, 40))}", f"{self.digits(1)}.{self.digits(1)}.{self.digits(2)}", f"{day}.{month}.{self.digits(3)}", f"{self.digits(2)}-{self.digits(2)}-{self.digits(4)}"])


#: Kinds whose valid format alone makes them personal, whatever the sentence says.
TOLD = frozenset(["iban", "national_id", "email_masked", "ipv6", "mac"])


def labelled(n: int, seed: int, personal: Mapping[str, Sequence[str]] = PERSONAL, other: Sequence[str] = OTHER) -> list[tuple[str, str, int, int, int]]:
    """n labelled spans (text, kind, start, end, label): valid spans in sentences that speak of them, and others."""
    draw, out = Spans(seed), []
    some = lambda k: " ".join(draw.pick(WORDS) for _ in range(k))
    while len(out) < n:
        kind = draw.pick(ADDED)
        cued, good = draw.rng.random() < 0.55, draw.rng.random() < 0.75
        sentence = draw.pick(personal[kind] if cued else other)
        label = int(good and (cued or kind in TOLD))
        if cued and not good and kind in ("ssn", "phone_local", "birth_date"):
            continue  # their other forms hold valid ones, and the sentence speaks of the kind: no telling
        span, lead = str(getattr(draw, kind)(good)), some(int(draw.rng.integers(0, 6)))
        lead = f"{lead}{draw.pick(['. ', ', ', ' ', ': '])}" if lead else ""
        start = len(lead) + sentence.index("{}")
        text = f"{lead}{sentence.replace('{}', span)}{draw.pick(['.', ',', '', ' ;'])} {some(5)}"
        out.append((text, kind, start, start + len(span), label))
    return out


def train(examples: int = 6000, seed: int = 11, precision: float = 0.97) -> Trees:
    """Fit the trees on ``examples`` labelled spans, calibrate on half as many in sentences kept from training."""
    part = lambda xs, keep: [x for i, x in enumerate(xs) if (i % 4 == 3) != keep] or list(xs)
    rows = labelled(examples, seed, {k: part(v, True) for k, v in PERSONAL.items()}, part(OTHER, True))
    held = labelled(examples // 2, seed + 1, {k: part(v, False) for k, v in PERSONAL.items()}, part(OTHER, False))
    x, y = np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float)
    model = boost(x, y, rounds=90)
    p, truth = model.score(np.array([features(*r[:4]) for r in held])), np.array([r[4] for r in held], float)
    for kind in ADDED:
        own = np.array([r[1] == kind for r in held])
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
        fit = np.flatnonzero(right >= precision)
        # midway under the lowest score down to which spans are precise enough, but never one that says no
        falling = np.append(p[own][order], 0.0)
        model.limits[kind] = max(float(falling[fit[-1] : fit[-1] + 2].mean()), 0.5) if len(fit) else 0.99
    return model


def spans_of(text: str, model: Trees) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans by kind and start, and the spans the trees add."""
    base = base_spans(text)
    taken = [(s, e) for _, s, e in base]
    seen = sorted(taken)
    starts = [s for s, _ in seen]
    inside = lambda s, e: any(seen[i][1] > s and seen[i][0] < e for i in range(max(0, np.searchsorted(starts, s) - 1), min(len(seen), np.searchsorted(starts, e))))
    found = [x for x in proposals(text) if not inside(*x[1:])]
    added: list[tuple[str, int, int]] = []
    if found:
        score = model.score(np.array([features(text, *x) for x in found]))
        good = sorted(((-s, x) for s, x in zip(score, found, strict=True) if s >= model.limits[x[0]]), key=lambda r: (r[0], r[1][1], KINDS.index(r[1][0])))
        used = np.zeros(len(text) + 1, bool) if len(good) > 1 else None
        for _, x in good:
            if used is None or not used[x[1] : x[2]].any():
                added.append(x)
                if used is not None:
                    used[x[1] : x[2]] = True
    order = lambda x: (KINDS.index(x[0]), x[1])
    return sorted(base, key=order), sorted(added, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind's mark."""
    out, at, done = [], 0, 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = done = e
        elif e > done:
            at = done = e
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: Trees, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_email, n_ip, n_card, n_phone, base, spans): counts and texts of the spans of every document."""
    schema = StructType([docs.schema[key]])
    for k in BASE:
        schema.add(f"n_{k}", LongType())
    schema.add("base_sha256", StringType()).add("spans", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spans_of(t or "", model) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(x[0] == k for x in b) for b, _ in found], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([joined(b + a) for b, a in found], pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def redact(docs: DataFrame, model: Trees, *, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its mark; null stays null."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [None if t is None else redacted(t, [x for part in spans_of(t, model) for x in part]) for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == where else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", examples: int = 6000) -> DataFrame:
    return detect(docs, train(examples), key=key, text=text).select(key, *(F.col(f"n_{k}") for k in BASE), "base_sha256", "spans")
