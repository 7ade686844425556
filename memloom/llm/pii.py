"""Personal data in free text: found by typed patterns, replaced by placeholders or by keyed surrogates (``surrogates``).

Numbers and addresses are told by their form and the words before them. Names are told by a known given name, or by their shape (two
to four capitalised words, or family name, comma, given name) where the words around them speak of a person: a title or label before, a
phrase of living, writing or being reached after, an address of mail made of the same name, or a row of names of which one is sure.
"""

from __future__ import annotations

import re
import secrets
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memloom.session import table

KINDS = ("email", "national_id", "phone", "street", "name")

# Common given names of several languages by gender; names that are not among them are told by their surroundings.
FEMALE = (
    "Agnès Alice Amelia Amina Ana Andrea Anna Anne Ayşe Barbara Beatriz Birgit Camille Carla Carmen Caroline Charlotte Chloé Christine Clara Claudia Diana Elena Elisabeth "
    "Elizabeth Emily Emma Eva Fatima Fiona Frida Grace Greta Hannah Helena Helga Ingrid Irina Isabel Jana Jane Jennifer Jessica Julia Karen Katharina Katrin Laura Leila "
    "Linda Lisa Louise Lucia Lucie Margaret Maria Marie Marta Martina Mary Mónica Monika Nadia Natalia Nicole Nina Nora Olga Olivia Patricia Petra Pilar Priya Rachel "
    "Renée Rosa Ruth Sabine Sandra Sara Sarah Silvia Sofia Sophie Susan Svetlana Teresa Ulrike Ursula Valérie Vera Victoria Wanda Yasmin Zoë"
).split()
MALE = (
    "Adam Ahmed Alan Albert Alexander Ali Andreas Andrew Anton Antonio Arthur Benjamin Bernd Björn Bruno Carlos Charles Christian Daniel David Diego Dieter Dmitri Edward "
    "Emil Eric Ernesto Fernando Francisco Frank François Georg George Giovanni Hans Hassan Heinrich Henrik Henry Hugo Ivan Jack Jakob James Jan Javier Jean Johann John "
    "Jonas Jörg José Juan Julian Jürgen Karl Kenji Klaus Lars Leon Louis Luca Luis Lukas Marco Marek Mario Mark Martin Matthias Max Michael Miguel Mohammed Nikolai Oliver "
    "Omar Oscar Pablo Patrick Paul Pedro Peter Philip Pierre Rafael Ralf Raúl Richard Robert Samuel Sergio Simon Stefan Sven Thomas Tomás Ulrich Victor Viktor Walter "
    "William Wolfgang Yusuf"
).split()
_SMALL = "The|This|That|These|Those|A|An|And|But|Or|If|In|On|At|It|Its|We|I|He|She|They|You|There|When|While|With|For|From|To|So|Not|No|Our|Der|Die|Das|Ein|Eine|Und|Wir|Es|Er|Sie|Ich|Im|In|Am|Le|La|Les|Un|Une|Et|Nous|On|Il|Elle|Ce|El|Los|Las|Y|En|Se|No|Su"
_UP, _LOW = r"A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ", r"a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļłńņňōőœŕřśşšţťūůűųźżž"
_PLAIN = rf"(?:(?:[Vv]an|[Vv]on|[Zz]u|[Dd]er|[Dd]en) )*(?:Mc|Mac|O['’]|D['’])?[{_UP}][{_UP}{_LOW}]+(?:[-’'][{_UP}][{_UP}{_LOW}]+)*"
_FAMILY = rf"(?:(?:[Vv]an|[Vv]on|[Dd]e|[Dd]er|[Dd]en|[Dd]i|[Dd]a|[Dd]el|[Ll]a|[Ll]e|[Zz]u) )*(?:Mc|Mac|O['’]|D['’])?[{_UP}][{_UP}{_LOW}]+(?:[-’'][{_UP}][{_UP}{_LOW}]+)*"
_plain = {"".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)) for n in FEMALE + MALE}
_given = sorted({n for n in (*FEMALE, *MALE, *_plain)} | {n.upper() for n in (*FEMALE, *MALE, *_plain)}, key=len, reverse=True)
_GIVEN = rf"(?:{'|'.join(_given)})(?:-(?:{'|'.join(_given)}))?(?![\w])"
GIVEN = re.compile(rf"(?<![\w.@+-]){_GIVEN}")
_AFTER = re.compile(rf"(?: [{_UP}]\.?)* {_FAMILY}(?![\w@]|-\w)")
_BEFORE = re.compile(rf"(?<![\w.@-]){_PLAIN}, ?$")
_TAIL = re.compile(rf"(?: [{_UP}]\.)?(?![\w@])")
INITIAL = re.compile(rf"(?<![\w.@-])[{_UP}]\. ?(?:[{_UP}]\. ?)*(?!(?:{_SMALL})\b){_FAMILY}(?![\w@]|-\w)")
FAMILY_INITIAL = re.compile(rf"(?<![\w.@-])({_PLAIN}), [{_UP}]\.(?: ?[{_UP}]\.)*(?!\w)")

# Names by shape and surroundings.
_WORD = rf"(?:(?:Mc|Mac|O['’]|D['’])?[{_UP}][{_LOW}]+(?:[-’'][{_UP}][{_LOW}]+)*)"
_LINK = r"(?:[Vv]an|[Vv]on|[Dd]e|[Dd]er|[Dd]en|[Dd]i|[Dd]a|[Dd]el|[Dd]os|bin|al|[Ll]a|[Zz]u)"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Srta|Don|Doña|Doctor|Professor)"
SHAPE = re.compile(rf"(?<![\w.@+'’-])(?!{_TITLE}\b){_WORD}(?:(?: [{_UP}]\.)* (?:{_LINK} )*{_WORD}){{1,3}}(?![\w@]|-\w)|(?<![\w.@+'’-]){_WORD}, {_WORD}(?: [{_UP}]\.)?(?![\w@]|-\w)")
#: Words with which no name begins or ends (places, days and months are those of the languages read).
_NO_NAME = re.compile(
    rf"(?:{_SMALL}|\w+ly|Lake|Mount|Port|Fort|New|North|South|East|West|Saint|Project|Team|Plan|Version|Chapter|Section|Figure|Table|Part|Page|Dear|Hello|Hi|Thanks|Please|Best|Kind|Re|"
    r"Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December|"
    r"Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|"
    r"Street|Road|Lane|Avenue|Drive|Square|University|Company|Inc|Ltd|Bank|Hotel|Hospital|School|City|River|Bridge|Station|User|Assistant|System)$"
)
BEFORE_PERSON = re.compile(
    rf"(?:\b{_TITLE}\.? "
    r"|(?i:\b(?:name|author|owner|contact|reviewer|from|attn|sender|recipient|assignee|customer|patient|employee|kunde|kontakt|autor|ansprechpartner(?:in)?|nom|auteur|nombre|cliente?)\"? ?[:=] ?\"?)"
    r"|(?i:\b(?:signed by|written by|my name is|ich hei(?:ß|ss)e|mein name ist|je m'appelle|me llamo|mi nombre es|(?:regards|sincerely|gr(?:ü|ue)(?:ß|ss)en?|cordialement|saludos),?)\s+))$"
)
AFTER_PERSON = re.compile(
    r",? (?:who )?(?:lives?|lived|can be reached|was born)\b|,? (?:ist unter|wohnt|geboren am)\b|,? (?:répond au|habite|né le|née le)\b|,? (?:atiende en|vive en|nació)\b|,? ?[<(|] ?[\w.+-]+@| \(ID\b"
)
PERSON_DOES = re.compile(r" (?:met|said|says|asked|told|wrote|writes|replied|thinks|thought|joined|agreed|sagte|schrieb|fragte|meinte|a dit|a écrit|dijo|escribió)\b")
DONE_TO_PERSON = re.compile(r"\b(?:met|asked|told|called|emailed|thanked|saw|visited) $")
_MAIL = re.compile(r"[\w.+-]*(?:@|\s?[\[({]\s?at\b)")
_BETWEEN = frozenset((", ", " and ", ", and ", " & ", " und ", " et ", " y "))

_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point|punto|DOT|Dot)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
# The sign first, then the local part to its left and the domain to its right.
AT = re.compile(r"@|＠|&#64;|\s?[\[({]\s?(?:at|AT|At|@|arroba|arobase)\s?[\])}]\s?|\s(?:at|AT)\s(?=[\w-]+(?:\s(?:dot|DOT)\s[\w-]+)+)|\s@\s(?=[\w-]+\.\w)")
LOCAL = re.compile(r"(?<![\w.+%-])[^\W_](?:[\w%+'-]|\.(?=[\w%+-]))*$")
DOMAIN = re.compile(rf"(?:[^\W_](?:[\w-]*[^\W_])?{_DOT})+[^\W\d_]{{2,}}(?![\w-]*@)")

NATIONAL = re.compile(
    r"(?<![\w.+-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"  # UK insurance number
    r"|\d{3}([- ])\d{2}\1\d{4}(?![\w-])"  # US
    r"|[12](?: \d{2}){3} \d{3} \d{3}(?: \d{2})?(?!\w)|[12]\d{2}(?:0[1-9]|1[0-9]|[2-9]\d)\d{8}(?:\d{2})?(?!\w)"  # French
    r"|\d{2} \d{3} \d{3} \d{3}(?!\w)"  # German tax number
    r"|(?:[XYZ]-?\d{7}|\d{8}|\d{2}\.\d{3}\.\d{3})-?[A-HJ-NP-TV-Z](?![\w-])"  # Spanish
    r")"
)
#: Digits told from other numbers by the words before them.
DIGITS = re.compile(r"(?<![\w.,:/+-])\d(?:[ ./-]?\d){7,14}(?:-?[A-Z])?(?!\w)")
ID_LABEL = re.compile(r"(?i:social security(?: number| no\.?)?|\bssn|national insurance(?: number| no\.?)?|steuer-?(?:id|nr\.?|nummer|identifikationsnummer)|\bidnr\.?|s[ée]curit[ée] sociale|\bdni|\bnie)[,:;]? {0,2}(?:n[o°º]\.? ?)?$")
PHONE_LABEL = re.compile(r"(?i:\btel(?:[ée]fono|ephone|\.|:|=)?|\bphone\"?:? ?\"?|\bcall|\btext|\bfax|llama al|atiende en el|appelez le|r[ée]pond au|\bunter|contacto|\bmobile?)[ :=\"]{0,3}$")
OTHER_LABEL = re.compile(r"(?i:epoch|\bid|\bts|timestamp|part no\.?|commit|rows|took)[ =:#]{0,2}$")
PHONE = re.compile(
    r"(?<![\w.,:/+-])(?:"
    r"\(?(?:\+|00)[1-9]\d{0,2}\)?(?:[ ./-]?\(0\))?(?:[ ./-]{0,2}\(?\d{1,}\)?){2,7}(?![\w])"  # with country code
    r"|\(?0[1-9]\d{1,4}\)?(?:[ ./-]{1,2}\d{2,8}){1,4}(?![\w])|0[1-9](?:[ .-]\d{2}){4}(?!\w)|0[1-9]\d{8,9}(?![\w.])"  # with trunk prefix
    r"|(?:1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\w)|1[2-9]\d{2}[2-9]\d{6}(?!\w)"  # North America
    r"|[6-9]\d{2}([ -])\d{3}\1\d{3}(?![\w-])|[6-9]\d{2}(?:([ -])\d{2})(?:\2\d{2}){2}(?![\w-])"  # Spain
    r")"
)
_EN = r"Street|St\.|Road|Rd\.?|Lane|Ln\.?|Way|Close|Avenue|Ave\.?|Drive|Dr\.|Court|Crescent|Terrace|Boulevard|Blvd\.?|Square|Gardens|Grove|Hill|Row|Walk|Mews|Place"
_DE = r"stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ring|ufer|damm|steig|pfad|chaussee"
_FR = r"rue|avenue|boulevard|bd|place|chemin|impasse|all[ée]e|quai|route|cours|passage|square|sentier|faubourg"
_ES = r"[Cc]alle|C/|[Aa]venida|[Aa]vda\.?|[Pp]laza|[Pp]za\.?|[Pp]aseo|[Cc]amino|[Rr]onda|[Cc]arretera|[Tt]raves[ií]a|[Gg]lorieta|CALLE|AVENIDA|PLAZA|PASEO|CAMINO"
_CAP = rf"[{_UP}][{_UP}{_LOW}'’]*(?:-[{_UP}{_LOW}]+)*"
_PART = r"(?:de la|de los|de las|del|de l['’]|des|du|de|d['’]|la|le|les|los|las|l['’]|DE LA|DEL|DES|DU|DE)"
#: Per language: strings of which any such address holds one, and the address.
STREETS = [
    (tuple(f" {w}" for x in _EN.replace("\\", "").split("|") for w in (x.rstrip(".?"), x.rstrip(".?").upper())), re.compile(rf"(?<![\w.,/-])\d{{1,5}} ?[A-Za-z]?(?<=[\dA-Za-z]) (?:{_CAP} ){{1,3}}(?:{_EN}|{_EN.upper()})(?![\w])")),
    (
        ("straße", "strasse", "str.", "weg ", "weg,", "gasse ", "gasse,", "allee ", "allee,", "platz ", "platz,", "ring ", "ring,", "ufer ", "ufer,", "damm ", "damm,", "steig ", "pfad ", "chaussee ", "Straße", "STRASSE", "STRAßE", "STR.", "WEG ", "GASSE ", "ALLEE ", "PLATZ ", "RING ", "UFER ", "DAMM "),
        re.compile(
            rf"(?<![\w-])(?:(?:{_CAP}[ -])?[{_UP}][{_UP}{_LOW}-]*(?:{_DE}|STRASSE|STRAßE|STR\.|WEG|GASSE|ALLEE|PLATZ|RING|UFER|DAMM)|{_CAP}[ -](?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Allee|Platz|Ring|Ufer|Damm)),? ?\d{{1,4}}(?: ?[a-zA-Z](?![\w.]))?(?!\w)"
        ),
    ),
    (tuple(f" {w} " for x in (*_FR.replace("all[ée]e", "allée|allee").split("|"),) for w in (x, x.title(), x.upper())), re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-dA-D])\b)?,? (?i:{_FR}) (?:{_PART} ?)*{_CAP}(?: (?:{_PART} ?)*{_CAP}){{0,3}}")),
    (("alle ", "C/ ", "venida ", "vda", "laza ", "za ", "za. ", "aseo ", "amino ", "onda ", "arretera ", "raves", "lorieta ", "CALLE ", "AVENIDA ", "PLAZA ", "PASEO ", "CAMINO "), re.compile(rf"(?<![\w-])(?:{_ES}) (?:{_PART} ?)*{_CAP}(?: (?:{_PART} ?)*{_CAP}){{0,3}},? (?:n\.?[ºo]\.? ?)?\d{{1,4}}(?: ?[a-zA-Z](?![\w.]))?(?!\w)")),
]
_WORDS = re.compile(r"[^\W\d_]+")
_GIVEN_SET = frozenset(_given)


def _ranges(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates, the more certain kinds first."""
    for m in AT.finditer(text):
        left = LOCAL.search(text, max(0, m.start() - 80), m.start())
        right = left and DOMAIN.match(text, m.end())
        if right:
            yield "email", left.start(), right.end()
    labelled = [(m, text[max(0, m.start() - 40) : m.start()]) for m in DIGITS.finditer(text)]
    yield from (("national_id", *m.span()) for m, before in labelled if ID_LABEL.search(before))
    yield from (("national_id", *m.span()) for m in NATIONAL.finditer(text))
    for m in PHONE.finditer(text):
        plain = m[0].isdigit()
        if (11 if plain and m[0][:2] == "00" else 8) <= sum(c.isdigit() for c in m[0]) <= 16 and not (plain and OTHER_LABEL.search(text, max(0, m.start() - 20), m.start())):
            yield "phone", *m.span()
    yield from (("phone", *m.span()) for m, before in labelled if m[0].isdigit() and len(m[0]) >= 9 and PHONE_LABEL.search(before))
    for hints, street in STREETS:
        if any(h in text for h in hints):
            yield from (("street", *m.span()) for m in street.finditer(text))
    families, sure = set(), []
    for m in () if _GIVEN_SET.isdisjoint(_WORDS.findall(text)) else GIVEN.finditer(text):
        before = _BEFORE.search(text, max(0, m.start() - 60), m.start())
        after = _AFTER.match(text, m.end())
        if before and text[before.start() : before.end()].rstrip(", ").split(" ")[-1] not in _SMALL.split("|") and not (after and GIVEN.match(text, before.start())):
            own = after is not None and not _known(text, before)
            if not own:
                families.add(before[0].rstrip(", "))
                sure.append((before.start(), _TAIL.match(text, m.end()).end()))
                yield "name", *sure[-1]
                continue
        if after:
            families.add(re.split(r" [^ ]\.? ", after[0])[-1].strip())
            sure.append((m.start(), after.end()))
            yield "name", *sure[-1]
    initials = [m.span() for m in INITIAL.finditer(text)]
    yield from (("name", *x) for x in initials)
    if families:
        yield from (("name", *m.span()) for m in FAMILY_INITIAL.finditer(text) if m[1] in families)
    yield from (("name", *x) for x in _shaped(text, [*sure, *initials]))


def _in_mail(family: str, after: str) -> bool:
    """Whether an address of mail in the text that follows is made of the family name."""
    if len(family) < 4 or not ("@" in after or "at" in after):
        return False
    low = after.lower()
    at = low.find(family)
    return at >= 0 and _MAIL.match(low, at + len(family)) is not None


def _shaped(text: str, sure: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Names by shape whose surroundings speak of a person, and those in a row with a sure one."""
    rows: list[list[tuple[int, int, bool]]] = []
    spans = sorted([(*m.span(), False) for m in SHAPE.finditer(text) if not any(m.start() < b and a < m.end() for a, b in sure)] + [(a, b, True) for a, b in sure])
    for a, b, known in spans:
        if not known:
            words = _WORDS.findall(text, a, b)
            if _NO_NAME.match(words[0]) or _NO_NAME.match(words[-1]):
                continue
        if rows and text[rows[-1][-1][1] : a] in _BETWEEN:
            rows[-1].append((a, b, known))
        else:
            rows.append([(a, b, known)])
    for row in rows:
        if all(known for _, _, known in row):
            continue
        first, last = row[0][0], row[-1][1]
        whole = any(known for _, _, known in row) or (PERSON_DOES.match(text, last) and "," not in text[row[-1][0] : last] and (len(row) > 1 or not first or text[first - 1] in "\n\"(" or text[first - 2] in ".!?:;,")) or DONE_TO_PERSON.search(text, max(0, first - 12), first)
        for a, b, known in row:
            comma = "," in text[a:b]
            if not known and (
                (whole and not comma)
                or BEFORE_PERSON.search(text, max(0, a - 40), a)
                or AFTER_PERSON.match(text, b)
                or (not comma and _in_mail(_WORDS.findall(text, a, b)[-1].lower(), text[b : b + 120]))
            ):
                yield a, b


def _known(text: str, before: re.Match) -> bool:
    """Whether the word before a comma stands as a family name rather than as an opening phrase (In Aldvik, ...)."""
    return not re.search(r"(?:^|[\s(])(?i:in|at|near|from|of|to|bei|von|nach|à|de|en|du|des|le|la|les|el|los|die|der|das|the|ist|is)$", text[: before.start()].rstrip()[-12:])


def found_in(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in a text, in order and without overlaps."""
    taken: list[tuple[str, int, int]] = []
    for kind, lo, hi in _ranges(text):
        if lo < hi and all(hi <= a or b <= lo for _, a, b in taken):
            taken.append((kind, lo, hi))
    return sorted(taken, key=lambda x: x[1])


def redacted(text: str) -> str:
    """The text with typed placeholders; all else unchanged."""
    out, at = [], 0
    for kind, lo, hi in found_in(text):
        out += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join(out) + text[at:]


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, h, kind, lo, hi, t[lo:hi]) for i, h, t in zip(*(b.column(c).to_pylist() for c in ("id", "hash", "text")), strict=True) for kind, lo, hi in found_in(t)]
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id", "hash", "kind", "start", "end", "passage"])


def located(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(id, hash, kind, start, end, passage) of every passage, with its place and the hash of its text; null and empty texts
    hold none, repeated rows give repeated passages, other columns are ignored. ``kind``: one of ``KINDS``."""
    base = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0).withColumn("hash", F.xxhash64("text"))
    return base.mapInArrow(_detect, "id string, hash long, kind string, start int, end int, passage string")


def personal_data(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(id, kind, passage) of every passage."""
    return located(df, key, text).select("id", "kind", "passage")


@F.pandas_udf(StringType())
def redact(texts: pd.Series) -> pd.Series:
    """Texts with typed placeholders; null stays null."""
    return texts.map(lambda t: redacted(t) if t else t)


def normal(passage):
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]", "")


def secret_of(spark: SparkSession) -> str:
    """The key of the surrogates: the setting ``memloom.surrogates.key``, or one drawn for this session."""
    key = spark.conf.get("memloom.surrogates.key", None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set("memloom.surrogates.key", key)
    return key


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of personal data in the entities' contents that has a surrogate (all have)."""
    from memloom.llm.surrogates import replacements

    r = replacements(table(spark, sf_dir, "entities"), secret_of(spark)).where("surrogate IS NOT NULL")
    return r.select("id", "kind", normal(F.col("passage")).alias("found")).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contents with typed placeholders."""
    return table(spark, sf_dir, "entities").select("id", redact("content").alias("content")).distinct()


def p6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed surrogate for every distinct passage found."""
    from memloom.llm.surrogates import surrogates

    return surrogates(personal_data(table(spark, sf_dir, "entities")), secret_of(spark))


def p6_pseudonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contents with surrogates in place of personal data."""
    from memloom.llm.surrogates import pseudonymised

    return pseudonymised(table(spark, sf_dir, "entities"), secret_of(spark))
