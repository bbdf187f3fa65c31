"""Surrogates for personal data: keyed, consistent in type, with collision checks.

Patterns find email addresses, IPv4 and IPv6 addresses, phone and account numbers, US social security numbers, IBANs,
secrets given as key = value, and names: after a form of address or an introduction, or a usual given name with a
capitalised word after it. Each entity is reduced to a core (digits of a number, lower-case form of an address or
name), so that all mentions of one entity get one surrogate in all documents. The core is enciphered by a keyed
permutation of all strings of its format: digits become digits (the first of a number keeps its kind), letters become
letters of the same case and script, check digits are made valid again where they were. Names are made word by word,
and a word has one surrogate wherever it stands ('Mr Smith', 'Dr John Smith'): a given name is drawn from a list of its
script and gender, every other word is a surname put together from syllables of the script. Names in scripts other than
Latin and Cyrillic are enciphered letter by letter. A mention gets the punctuation and the case of the original.

The gender of a given name is that of the form of address ('Herr'); after one without gender ('Dr') it is that of the
list of usual names, or else the one gender with which the corpus uses the word elsewhere; a name of neither gets a
name of both. A word alone is a given name if it is a usual one, otherwise a surname.

Collision checks. The distinct entities of the corpus, a small table, are given surrogates and compared with each
other and with all real entities. An entity whose surrogate is taken or real gets another one, until none is left. Names
are checked by words: no two words in one role get one surrogate, no surname gets a real surname, no given name itself.
Each further attempt draws anew and in the end from a larger space, so that the search ends however many values of a
format are real: a surname has one more syllable, a given name one more part ('Anna-Maria'), a mail address one more
letter; other formats keep their length for NARROW attempts and then grow by a character each. Only these exceptions
travel: as a broadcast if there are at most MAX_BROADCAST of them, otherwise by a join that only the documents
concerned take part in. All other documents compute their surrogates where they are.

The key comes from the caller. Whoever has it can undo the permutations.

Defined cases: a null text stays null; a text without entities is unchanged to the byte; equal rows get equal texts;
entities that overlap are resolved to the one that begins first, the longest of a kind; a secret without a letter or
digit (a mask such as ****) is none; an empty table stays empty; further columns are carried; where the input has a
column of the name of the added one, the added one gets underscores in front.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.bloomdedup import bit_filter, filter_bits, marked, position
from kinweave.llm.tokens import free_name, hold, small_batches, trim
from kinweave.staging import drop_staged, stage

MAX_BROADCAST = 200_000
#: Attempts after which a format of fixed length grows.
NARROW = 4
#: Names by gender, and forms of address with the gender that they tell.
NAMES = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Clara Sofia Lucia Elena Marta Alice Camille Louise Jeanne Claire Helene Ingrid Greta Hannah Lena Carmen Pilar Rosa Teresa Isabel Susan Karen Nancy Linda Grace".split(),
    ("latin", "n"): "Alex Robin Sascha Charlie Dominique Claude Jamie Taylor Morgan Noa Eden Kai Ariel Sidney Leslie".split(),
    ("latin", "m"): "Paul Peter Thomas Martin Daniel David Robert Michel Pierre Louis Jean Antoine Hans Karl Jonas Felix Stefan Andreas Carlos Miguel Jorge Pablo Diego Luis James George Henry Frank Walter Simon".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Татьяна Наталья Светлана Вера Дарья".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Юрий".split(),
}
#: Further usual given names, by gender, that only serve to find names.
USUAL = {
    "f": "Mary Jane Jessica Sarah Elizabeth Jennifer Patricia Barbara Margaret Sandra Emily Olivia Lisa Katharina Sabine Monika Ursula Petra Sophie Marie Juliette Chantal Ana Luisa Beatriz Priya Fatima".split(),
    "m": "John William Richard Michael Joseph Charles Christopher Edward Brian Kevin Steven Hans Klaus Wolfgang Jürgen Uwe Dieter François Jacques Philippe Nicolas José Juan Antonio Manuel Francisco Javier Ahmed Mohammed Rahul".split(),
}
#: Parts of surnames: how a syllable begins, its vowel, how the name ends. Three syllables give 233 and 50 million surnames.
SYLLABLES = {
    "latin": ("b br d dr f fl g gr h j k kl kr l m n p pr r s sh st t tr v w z sp gl bl".split(), "a e i o u ei".split(), "mann sen ler ner ton son feld berg stein well ford mer ker vin lin rat nard bert mond dal lund quist gren holm wick more land ham low ster ley by nez rez let rand sier din ron cott".split()),
    "cyrillic": ("б бр в г гр д др ж з к кл кр л м н п пр р с ст т тр х ш".split(), "а е и о у".split(), "нко вский ров лев нин тов дин мук чук вич гин хин рев рин зов ков лин сов мов бин хов шин нюк ман тюк лык рец нец".split()),
}
ADDRESS = {
    "m": "Mr Mister Sir Herr Herrn Monsieur M Señor Sr Don господин".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Doña госпожа".split(),
    "n": ["Dr", "Prof", "my name is", "My name is", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут"],
}
_GENDER = {v: g for g, words in ADDRESS.items() for w in words for v in (w, w.upper())}
_USUAL = {n.casefold(): g for g in "fm" for n in [*USUAL[g], *NAMES["latin", g], *NAMES["cyrillic", g]]}
_USUAL_WRITTEN = frozenset(v for n in _USUAL for v in (n.title(), n.upper()))
_NAME = r"[^\W\d_][^\W\d_a-zà-ÿа-я]{0,0}[\w'’-]{0,40}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Each pattern begins at a boundary that its own characters cannot cross, so that a search is linear in the text.
_AT = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?!\w)")
_DIGITS = re.compile(
    r"(?P<ipv6>(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:]))"
    rf"|(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<account>(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?)(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w+(.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d(?:[ .-]\d{2}){4})(?![\w-]|\.\d))"
)
_SSN = re.compile(r"(?<!\w)(?i:ssn|social security(?: number| no\.?)?)[ :=#]{1,3}(?P<ssn>\d{3}[ -]?\d{2}[ -]?\d{4})(?!\w)")
_DIGIT_RUN = re.compile(r"\d[\d .:()A-Fa-f-]{5}|(?<!\w)[A-Z]{2}\d{2}|(?i::[0-9a-f]{1,4}){3}")
_SECRET = re.compile(r"""(?i:(?<![^\W_])(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key))["']?\s{0,3}[=:]\s{0,3}["']?(?P<secret>(?=[^\s"'<>,;]{0,199}[^\W_])[^\s"'<>,;]{8,200})""")
_PERSON = re.compile(r"(?<!\w)(?P<form>" + "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True)) + rf")(?:\. ?| )(?P<name>(?:(?=[^\W\d_a-zа-я]){_NAME})(?: (?=[^\W\d_a-zа-я]){_NAME}){{0,2}})")
_FULL_NAME = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_USUAL_WRITTEN, key=len, reverse=True))})(?: (?=[^\W\d_a-zа-я]){_NAME}){{1,2}}")
_SECRET_WORD = re.compile(r"(?i)key|secret|token|passw|pwd")
_UPPER_FORM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True)) + r")[. ]")


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, gender) of each entity, in order and without overlap. The gender is only told of names."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email", "") for m in _AT.finditer(text)]
    if _DIGIT_RUN.search(text):
        found += [(*m.span(), m.lastgroup, "") for m in _DIGITS.finditer(text)]
        found += [(*m.span("ssn"), "ssn", "") for m in _SSN.finditer(text)]
    if _SECRET_WORD.search(text):
        found += [(*m.span("secret"), "secret", "") for m in _SECRET.finditer(text)]
    if _UPPER_FORM.search(text):
        found += [(*m.span("name"), "name", _GENDER[m["form"]]) for m in _PERSON.finditer(text)]
    if not _USUAL_WRITTEN.isdisjoint(text.split()):
        found += [(*m.span(), "name", "n") for m in _FULL_NAME.finditer(text)]
    out, end = [], -1
    for a, b, kind, gender in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b, kind, gender))
            end = b
    return out


def core_of(kind: str, mention: str, gender: str) -> str:
    """What all mentions of an entity have in common; of a phone number also the country, of a name the gender."""
    if kind == "email":
        return mention.lower()
    if kind == "phone":
        m = re.match(r"\+(\d{1,3})(?=[ .(-])", mention)
        digits = re.sub(r"\D", "", mention[m.end() :] if m else mention)
        return f"{m[1] if m else ''}|{digits}"
    if kind in ("account", "ssn"):
        return re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "ipv6":
        return mention.lower()
    if kind == "name":
        words = unicodedata.normalize("NFC", mention).casefold()
        return f"{gender if gender != 'n' else _USUAL.get(words.split(' ')[0], 'n')}|{words}"
    return mention


class Cipher:
    """A keyed permutation of all strings of one format, by a Feistel network with cycle walking."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, n: int, size: int, kind: str) -> int:
        """A permutation of range(size), different for each kind and size."""
        if size <= 1:
            return n
        half = 1
        while half * half < size:
            half *= 2
        width = (half.bit_length() + 7) // 8
        while True:
            left, right = divmod(n, half)
            for r in range(6):
                data = f"{kind}|{size}|{r}|".encode() + right.to_bytes(width, "big")
                left, right = right, (left + int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, width + 8)).digest(), "big")) % half
            n = left * half + right
            if n < size:
                return n

    def text(self, s: str, kind: str, classes: list[str]) -> str:
        """Replace every character by one of its class (a string of alternatives); an empty class keeps it."""
        n, size = 0, 1
        for c, alternatives in zip(s, classes):
            if alternatives:
                n, size = n * len(alternatives) + alternatives.index(c), size * len(alternatives)
        shape = "".join(a[0] if a else c for c, a in zip(s, classes))
        n, out = self.number(n, size, f"{kind}|{shape}"), list(s)
        for i in range(len(s) - 1, -1, -1):
            if classes[i]:
                n, k = divmod(n, len(classes[i]))
                out[i] = classes[i][k]
        return "".join(out)


@lru_cache(maxsize=4096)
def _class(c: str) -> str:
    """The characters that may stand for `c`: digits for digits, letters of its script and case for letters."""
    for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in a:
            return a
    if not c.isalpha():
        return ""
    block, kind = ord(c) // 64 * 64, unicodedata.category(c)
    return "".join(chr(i) for i in range(block, block + 64) if unicodedata.category(chr(i)) == kind)


def _kept_first(digits: str) -> list[str]:
    """Digits for digits; the first keeps its kind (0 and 1 begin no subscriber number)."""
    return [("01" if c in "01" else "23456789") if i == 0 else "0123456789" for i, c in enumerate(digits)]


def luhn(digits: str) -> int:
    """The check digit that completes `digits`."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def surrogate(cipher: Cipher, kind: str, core: str, attempt: int = 0) -> str:
    """The core that stands for `core` at an attempt: for each format and attempt a permutation of its own."""
    more, own = max(0, attempt - NARROW), f"{kind}#{attempt}"
    if kind == "email":
        local, _, domain = core.rpartition("@")
        host, _, top = domain.rpartition(".")
        # mail hosts are entities of their own: one host, one surrogate
        local += "a" * attempt
        return cipher.text(local, own, [_class(c) for c in local]) + "@" + cipher.text(host, "host", [_class(c) for c in host]) + "." + top
    if kind == "ip":
        n = cipher.number(sum(int(o) << (24 - 8 * i) for i, o in enumerate(core.split("."))), 1 << 32, own)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0)) + ("-" + cipher.text("0" * more, own + core, ["0123456789"] * more) if more else "")
    if kind == "ipv6":
        n = cipher.number(sum(int(o, 16) << (112 - 16 * i) for i, o in enumerate(core.split(":"))), 1 << 128, own)
        return ":".join(f"{n >> s & 65535:x}" for s in range(112, -1, -16))
    if kind == "phone":
        core += "0" * more
        return cipher.text(core, own, _kept_first(core))
    if kind == "account":
        body = core[1:-1] + "0" * more
        if luhn(core[:-1]) == int(core[-1]):
            body = cipher.text(body, "luhn" + own + core[0], ["0123456789"] * len(body))
            return core[0] + body + str(luhn(core[0] + body))
        return core[0] + cipher.text(body + core[-1], own + core[0], ["0123456789"] * (len(body) + 1))
    if kind == "ssn":
        core += "0" * more
        return cipher.text(core, own, ["0123456789"] * len(core))
    if kind == "iban":
        country, rest = core[:2], core[4:] + "0" * more
        rest2 = cipher.text(rest, own + country, [_class(c) for c in rest])
        return country + (_iban_check(country, rest2) if _iban_check(country, core[4:]) == core[2:4] else core[2:4]) + rest2
    hexed = re.fullmatch(r"(?:0x)?([0-9a-f]{8,}|[0-9A-F]{8,})", core)
    if hexed:
        digits = "0123456789abcdef" if hexed[1] == hexed[1].lower() else "0123456789ABCDEF"
        head, body = core[: len(core) - len(hexed[1])], hexed[1] + "0" * more
        return head + cipher.text(body, own, [digits] * len(body))
    core += "a" * more
    return cipher.text(core, own, [_class(c) for c in core])


def _script(word: str) -> str:
    return "cyrillic" if "а" <= word[0] <= "я" or word[0] == "ё" else "latin" if word[0] < "ɐ" else ""


def _draw(cipher: Cipher, *what) -> int:
    """A keyed number of 256 bits."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, what)).encode(), key=cipher.key, digest_size=32).digest(), "big")


def _enciphered(cipher: Cipher, word: str, role: str, attempt: int) -> str:
    word += word[-1] * attempt
    classes = [_class(c) for c in word]
    if all(len(c) < 2 for c in classes):
        # nothing in the word can change
        return _syllables(cipher, word, "latin", attempt)
    return cipher.text(word, f"name|{role}|{attempt}", classes)


def _syllables(cipher: Cipher, word: str, script: str, attempt: int) -> str:
    begins, vowels, ends = SYLLABLES[script]
    out = ""
    for k in range(3 + attempt):
        n, i = divmod(_draw(cipher, "surname", attempt, k, word), len(begins))
        out += begins[i] + vowels[n % len(vowels)]
    return out + ends[_draw(cipher, "surname", attempt, "end", word) % len(ends)]


def surname(cipher: Cipher, word: str, attempt: int) -> str:
    """The surname that stands for a word: each attempt draws from a space of names one syllable longer."""
    script = _script(word)
    return _syllables(cipher, word, script, attempt) if script else _enciphered(cipher, word, "s", attempt)


def given_name(cipher: Cipher, word: str, gender: str, attempt: int) -> str:
    """The given name that stands for a word: names of the gender, one more of them at each attempt."""
    script = _script(word)
    if not script:
        return _enciphered(cipher, word, gender, attempt)
    names = NAMES[script, gender]
    return "-".join(names[_draw(cipher, "given", gender, attempt, k, word) % len(names)] for k in range(attempt + 1)).casefold()


def name_words(core: str) -> tuple[str, list[str]]:
    """The given name (or nothing) and the surnames of the core of a name."""
    words = core.split("|", 1)[1].split(" ")
    return (words[0], words[1:]) if len(words) > 1 or words[0] in _USUAL else ("", words)


def name_surrogate(cipher: Cipher, core: str, exceptions: dict[tuple[str, str], int]) -> str:
    gender, (given, rest) = core.split("|", 1)[0], name_words(core)
    made = [surname(cipher, w, exceptions.get(("surname", w), 0)) for w in rest]
    if given:
        if gender == "n":
            gender = "nmf"[exceptions.get(("gender", given), 0)]
        made.insert(0, given_name(cipher, given, gender, exceptions.get(("given", f"{gender}|{given}"), 0)))
    return " ".join(made)


def nth_surrogate(cipher: Cipher, kind: str, core: str, attempt: int) -> str:
    """After `attempt` collisions, of what the checks see. Given names are compared as they are written, without their gender."""
    if kind == "surname":
        return surname(cipher, core, attempt)
    if kind == "given":
        gender, word = core.split("|", 1)
        return given_name(cipher, word, gender, attempt)
    return surrogate(cipher, kind, core, attempt)


def written_like(kind: str, core: str, mention: str) -> str:
    """The surrogate core with the punctuation and case of the mention."""
    if kind in ("phone", "account", "ssn"):
        supply = iter(core.replace("|", ""))
        return "".join(next(supply, c) if c.isdigit() else c for c in mention) + "".join(supply)
    if kind == "iban":
        supply = iter(core)
        return "".join(c if c == " " else next(supply) for c in mention) + "".join(supply)
    if kind == "name":
        return core.upper() if mention.isupper() and len(mention) > 1 else re.sub(r"(?<![^ -]).", lambda m: m[0].upper(), core)
    if kind in ("email", "ipv6") and mention != mention.lower():
        return "".join(c.upper() if m.isupper() else c for c, m in zip(core, mention)) if len(core) == len(mention) else core
    return core


def replace_entities(text: str, cipher: Cipher, exceptions: dict[tuple[str, str], int]) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and how many of each kind."""
    found = find_entities(text)
    if not found:
        return text, {}
    out, at, counts = [], 0, {}
    for a, b, kind, gender in found:
        mention = text[a:b]
        core = core_of(kind, mention, gender)
        if kind == "name":
            made = name_surrogate(cipher, core, exceptions)
        elif kind == "phone":
            country, digits = core.split("|")
            made = f"{country}|{surrogate(cipher, kind, digits, exceptions.get((kind, digits), 0))}"
        else:
            made = surrogate(cipher, kind, core, exceptions.get((kind, core), 0))
        out += [text[at:a], written_like(kind, made, mention)]
        counts[kind] = counts.get(kind, 0) + 1
        at = b
    return "".join([*out, text[at:]]), counts


def checked(kind: str, core: str) -> list[tuple[str, str]]:
    """What the collision checks see of an entity: of a name its words, of a phone number the digits without the country."""
    if kind == "phone":
        return [(kind, core.split("|")[1])]
    if kind != "name":
        return [(kind, core)]
    given, rest = name_words(core)
    return [("surname", w) for w in rest] + ([("given", f"{core.split('|', 1)[0]}|{given}")] if given else [])


def entities(texts: DataFrame) -> DataFrame:
    """text_hash, kind, core of the entities of each text (columns text_hash, text), each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, core in {x for a, b, kind, g in find_entities(t or "") for x in checked(kind, core_of(kind, t[a:b], g))}:
                    for column, v in zip(out, (h, kind, core)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["text_hash", "kind", "core"])
        trim()

    return texts.mapInArrow(run, "text_hash long, kind string, core string")


def _with_surrogates(cores: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for batch in batches:
            made = [nth_surrogate(cipher, *x) for x in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "core", "attempt", "made"])

    return cores.select("kind", "core", "attempt").mapInArrow(run, "kind string, core string, attempt int, made string")


def _genders(cores: DataFrame) -> DataFrame:
    """kind = gender, core = the given name, attempt = 1 (m) or 2 (f): names without gender here that have one gender elsewhere."""
    given = cores.where("kind = 'given'").select(F.substring("core", 1, 1).alias("g"), F.expr("substring(core, 3)").alias("core"))
    seen = given.groupBy("core").agg(F.bool_or(F.col("g") == "n").alias("n"), F.bool_or(F.col("g") == "m").alias("m"), F.bool_or(F.col("g") == "f").alias("f"))
    return seen.where("n AND m <> f").select(F.lit("gender").alias("kind"), "core", F.when(F.col("m"), 1).otherwise(2).alias("attempt"))


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """kind, core, attempt of the entities whose first surrogate does not stand, and the genders that the corpus tells."""
    spark = found.sparkSession
    cores, _ = stage(found.select("kind", "core").distinct(), "entities")
    genders, _ = stage(_genders(cores), "genders")
    # a name whose gender is known by another mention is the entity of that mention
    told = genders.select(F.lit("given").alias("kind"), F.concat(F.lit("n|"), "core").alias("core"))
    current, path = stage(_with_surrogates(cores.join(told, ["kind", "core"], "left_anti").withColumn("attempt", F.lit(0)), key), "made")
    real = cores.where("kind <> 'given'").select("kind", F.col("core").alias("made"))
    while True:
        # the smallest core of those that share a surrogate keeps it
        taken = current.groupBy("kind", "made").agg(F.min(F.struct("attempt", "core")).alias("first"), F.count("*").alias("n")).where("n > 1")
        same = current.where("kind = 'given' AND made = substring(core, 3)")
        again = current.join(real, ["kind", "made"], "left_semi").unionByName(same).select("kind", "core", "attempt").union(current.join(taken, ["kind", "made"]).where("core <> first.core").select("kind", "core", "attempt")).distinct()
        again, again_path = stage(again, "again")
        if again.isEmpty():
            return genders.unionByName(current.where("attempt > 0").select("kind", "core", "attempt"))
        redone = _with_surrogates(again.withColumn("attempt", F.col("attempt") + 1), key)
        current, new_path = stage(current.join(again.select("kind", "core"), ["kind", "core"], "left_anti").select("kind", "core", "attempt", "made").unionByName(redone), "made")
        drop_staged(spark, path)
        drop_staged(spark, again_path)
        path = new_path


_KEYS: dict[str, bytes] = {}


def session_key(spark) -> bytes:
    """The key of the setting spark.kinweave.surrogates.secret; without it one that is drawn once a session and kept nowhere."""
    given = spark.conf.get("spark.kinweave.surrogates.secret", None)
    return given.encode() if given else _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def replace_personal_data(docs: DataFrame, key: bytes, text: str = "text", max_broadcast: int = MAX_BROADCAST, counted: str = "replaced") -> DataFrame:
    """`docs` with surrogates in the column `text`, and the column `counted` (map of kind to count).

    `key` (1 to 64 bytes) is a secret of the caller; one key gives one entity one surrogate.
    """
    if not 0 < len(key) <= 64:
        raise ValueError("surrogates need a secret key of 1 to 64 bytes")
    docs = small_batches(docs)
    counted = free_name(docs, counted)
    hashed = F.xxhash64(text)
    found, _ = stage(entities(docs.where(F.col(text).isNotNull()).select(hashed, F.col(text))), "found")
    odd, _ = stage(exceptions(found, key), "exceptions")
    n, names, at = odd.count(), docs.columns, docs.columns.index(text)

    def rewrite(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold("surrogates")
            cipher, common = Cipher(key), shared.value if shared else {}
            for batch in batches:
                given, out, counts = batch.column(at).to_pylist(), [], []
                own = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * len(given)
                for t, mine in zip(given, own):
                    special = {(x["kind"], x["core"]): x["attempt"] for x in mine} if mine else common
                    new, count = replace_entities(t, cipher, special) if t is not None else (None, {})
                    out.append(new)
                    counts.append(sorted(count.items()))
                columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.map_(pa.string(), pa.int32()))], [*own_names, "counts"])
            trim()

        return run

    # by place: mapInArrow cannot read names with dots
    own_names = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([*(T.StructField(c, f.dataType, True) for c, f in zip(own_names, docs.schema.fields)), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))])
    if n <= max_broadcast:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["core"]): r["attempt"] for r in odd.collect()})
        return docs.toDF(*own_names).mapInArrow(rewrite(shared), schema).toDF(*names, counted)
    # equal texts bring equal rows: each entity of a text once, however many copies the text has
    word = F.expr("substring(core, 3)")
    linked = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("core")) for k, c in (("gender", word), ("given", F.concat(F.lit("m|"), word)), ("given", F.concat(F.lit("f|"), word)))])
    also = found.where("kind = 'given' AND startswith(core, 'n|')").select("text_hash", F.inline(linked))
    per_text = found.unionByName(also).distinct().join(odd, ["kind", "core"]).groupBy("text_hash").agg(F.collect_list(F.struct("kind", "core", "attempt")).alias("_kw_odd"))
    per_text, _ = stage(per_text, "per-text")
    bits = filter_bits(per_text.count())
    pieces, _ = stage(bit_filter(per_text.select(position(F.col("text_hash"), bits).alias("pos")), bits), "filter")
    here = F.coalesce(marked(pieces.select("pieces").scalar(), position(hashed, bits)), F.lit(False))
    h, odd_name = free_name(docs, "h"), free_name(docs, "odd")
    joined = docs.where(here).join(per_text.select(F.col("text_hash").alias(h), F.col("_kw_odd").alias(odd_name)), hashed == F.col(h), "left").drop(h)
    both = docs.where(~here).toDF(*own_names).mapInArrow(rewrite(None), schema).unionByName(joined.toDF(*own_names, "odd").mapInArrow(rewrite(None), schema))
    return both.toDF(*names, counted)
