"""Text quality statistics, and whether a text is prose.

Every line is described by two distributions: what its tokens are (function words of a language, other words, numbers, names and codes,
marks that stand free or join what is on both sides, words repeated at once) and which classes its characters belong to. Its profile is the
one nearest in Jensen-Shannon divergence, out of prose profiles of each language and profiles of structures (list, table, log, code, data,
heap, tags, garbage). A text is prose unless more than half of its non-blank characters stand in lines of structural profiles. Lines that a
sentence runs over count as one, and a short line is judged together with its neighbours.

Profiles are the means of the labelled examples below, written for this purpose; ``tests/llm`` holds others out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.words import words
from memloom.session import table

# Common function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their if will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now did get come made may i you he me my our us do does just only after before again over under once off".split(),
    "de": "der die das und in zu den von mit ist des im für nicht ein eine auf dem sich als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wir ich du was wenn ihr unter kann ohne gegen denn da hier alle dieser diese dieses".split(),
    "fr": "de la le et les des en un une du dans est que pour qui il sur au plus par ce pas ne se son avec sont ou sa aux mais comme nous ces été ont cette on elle été sans sous leur était même si deux tout je tu vous ils être fait avant après où entre dont ni ses".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde nos durante ni contra ese eso yo tu él ella donde porque".split(),
}
COMMON = sorted(set().union(*FUNCTION_WORDS.values()))
_LANGUAGES = list(FUNCTION_WORDS)
_OF = {w: frozenset(k for k, lang in enumerate(_LANGUAGES) if w in FUNCTION_WORDS[lang]) for w in COMMON}

EXAMPLES = {
    "prose_en": [
        "The old mill by the river was sold last spring, and nobody knows what the new owners will do with it.",
        "we talked about the trip for an hour and then went home because it was getting late",
        "While she was reading the report, two of the 14 visitors left without a word.",
        "About 300 pages were lost in the move, although most of them had been copied before.",
        "Does anyone still use the printer that stands next to the stairs?",
        "User: can you tell me why the lamp in the hall keeps going out at night",
        "Thanks, that fixed it.",
        "Leave the small kettle with its three cups alone in spite of the frost.",
    ],
    "prose_en_names": ["Arvid Holm, Tove Berg and Ines Costa met Jonas Roth in Oslo.", "On Tuesday Lindholm wrote to Dr. Marta Kowal from Krakow about the Baltic Museum.", "In Ostrava, Torben compared the Nordhaven archive with Brixwell."],
    "prose_en_numbers": ["Sales fell 12% to 4.1 million in 2019, the agency said.", "The fee of $3.50 rose by 20% on 1 May 2021, after 14 years at 2.90.", "After 4821 tries and 77 hours the pump had moved 3.2 tons of sand."],
    "prose_de": [
        "Die alte Mühle am Fluss wurde im Frühjahr verkauft, und niemand weiß, was daraus werden soll.",
        "Wir haben 12 Briefe für die Nachbarn angenommen, trotz der späten Stunde.",
        "Warum bleibt der Zug eigentlich immer vor dem Tunnel stehen?",
        "heute trägt das kleine boot ganz klar die schwere last von gestern",
        "Ohne den Schlüssel Lindholm bleibt die Kammer Brixwell verschlossen, aus gutem Grund.",
    ],
    "prose_fr": [
        "Le vieux moulin près de la rivière a été vendu au printemps, et personne ne sait ce qu'il va devenir.",
        "Environ 20 lettres sont arrivées chez les voisins, malgré l'heure tardive.",
        "Pourquoi le train reste-t-il toujours devant le tunnel ?",
        "Sans la clé Lindholm, Brixwell reste fermé pour la seconde fois.",
    ],
    "prose_es": [
        "El viejo molino junto al río se vendió en primavera, y nadie sabe qué van a hacer con él.",
        "Unas 20 cartas llegaron a la casa de los vecinos, a pesar de la hora.",
        "¿Por qué se queda siempre el tren delante del túnel?",
        "Sin la llave Lindholm, Brixwell queda cerrado por segunda vez.",
    ],
    "prose_ja": ["川のそばの古い水車小屋は春に売られ、これからどうなるのか誰も知らない。", "遅い時間だったが、隣の家に20通の手紙が届いた。", "なぜ電車はいつもトンネルの前で止まるのですか。"],
    "list": [
        "- green lamp of Arvid, Torben", "* blue chair (42)", "3. short rope, Lindholm", "(4) third plate of Ostrava", "[ ] clean kettle (7)", "- [x] Berlin / small map of Oslo", "• winter coat", "2) die kleine Lampe Arvid, Torben",
        "§4 la petite lampe, Lindholm", "5) la lámpara verde, Arvid", "§2 das kleine Boot Lindholm, Torben",
    ],
    "list_menu": ["Lamp Arvid", "Settings", "Home", "About us", "Map Lindholm", "Chair"],
    "list_bar": ["Lamp · Settings · Rope Arvid · Plate · Chair Lindholm · Map", "Home » Lamp » Chair Lindholm » Map Arvid » Rope", "Home | Lamp | Chair Lindholm | Map | Rope Arvid"],
    "table_bars": ["| id | name | count | state |", "| 3fa9c1 | Arvid lamp | 4821 | ok |", "| 77ab10 | Lindholm | 312 | - |"],
    "table_rule": ["|---|---|---:|---|"],
    "table_head": ["key,name,score,ts,note", "key;name;score;ts;note", "id;lamp;rope;map"],
    "table_rows": ["a81b2c;arvid;0.5312;1523456789;new", "b71f,lindholm,0.88,1623456780,", "9c20;torben;0.12;1423456780;NA"],
    "table_tabs": ["77ab10\tarvid\t0.4412\t1555555555\tNA", "key\tname\tscore\tts\tnote", "a81b2c\tlindholm\t0.88\t1623456780\tnew"],
    "log": ["2021-03-04 10:11:12.345 ERROR [lamp-7] Arvid rows=120 took=35ms id=9a8b7c6d from 10.0.0.7", "2021-03-04T10:11:12Z INFO main: started worker 12 in 340ms", "[2021-03-04 10:11:12] WARN retry=3 host=10.0.0.9 code=503"],
    "code_for": ["for x in lamp.items():", "for rope in arvid.short_ropes():", "    if x.size > 12:", "def small_lamp(arvid, k=3):"],
    "code_call": ["        lamp.drop(x.id, 'a81b')", "    return [f(i) for i in range(k) if i % 7]", "    ropes = [arvid[i] for i in range(k) if i % 80]", "@cached(ttl=30)", "return total(x)[:12]"],
    "code_word": ["    continue", "```", "    pass", "else:"],
    "code_js": ["const a = require('small-lamp@1.2.3');", "if (!a.ok) { throw 404; }", "a.open({ size: 12, key: 'x81' });"],
    "code_sql": ["SELECT lamp, count(*) FROM arvid_small", "WHERE lamp_id > 4821 AND small = 'a81b'", "GROUP BY lamp HAVING count(*) > 3;"],
    "data": ['{"small_lamp_3": "a81b2c", "third_plate_7": true, "rope_4": 0.4412}', '  "winter_coat_9": 48213,', '  "chairs_2": ['],
    "data_item": ['    "Arvid",', "    86", "  ],", "{", "}"],
    "data_pairs": ["owner=Arvid;size=12;key=a81b2c", "lamp.size: 12", "retry_count = 3", "[section.lamp]"],
    "heap": ["lamp, arvid, rope, plate, 421, rope, rope, lamp, chair", "421, lamp, Arvid, Arvid, lamp, 421, rope, lamp, Arvid, rope, lamp"],
    "heap_bars": ["lamp | rope | rope | 421 | Arvid | lamp | plate", "lamp >> rope >> 421 >> arvid >> rope"],
    "heap_blank": ["lamp rope arvid rope plate 421 lamp rope chair", "rope rope 421 Arvid lamp lamp 421 rope Arvid lamp lamp rope"],
    "tags": ["#smalllamp #winterrope12 #thirdplate #bluechair7 #lampmap", "#lamp #rope"],
    "garbage": ["*****************7a1b", "~~~~~~~~~~~~~~~~", ".:.:.:.:.:.:.:.:c9", "/\\/\\/\\/\\/\\/\\0f", "################", "=-=-=-=-=-=", "---------------------a05e"],
    "garbage_mixed": ["x9$%k&&q!!zz@@#w", "ÃƒÂ©Ã¢â‚¬â„¢", "1;¿�±œ3e%�Ÿ½$2}0@¸^!3f"],
    "garbage_code": ["QmFzZTY0IGRhdGEgaXMgbm90IHByb3Nl", "zQ8gfiS2Sk/YabJa7fpqo6E6QPdXVVlw+0y3faFvsLeU4P0N2dv8HVBx"],
}
PROFILES = list(EXAMPLES)

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\w+|[^\w\s]+")
_MARK = re.compile(r"\s*(?:[-*•+–]|\(?\d{1,3}[.)]|§ ?\d+|\(?[a-z][.)]|\[[ xX]\])\s")
_QUOTE, _EMPHASIS, _HEADING = re.compile(r"^(?:> ?)+"), re.compile(r"(\*\*|__|`)(?=\S)([^*_`\n]+?)\1"), re.compile(r"^#{1,6} ")
_PROSE_MARKS, _END = frozenset(".,!?;:'\"’‘“”«»…¿¡()-–—、。！？「」%$€£"), frozenset(".!?…。！？")
_LOUD, _SHOUTED = re.compile(r"[A-ZÀ-Þ]{2} [A-ZÀ-Þ]"), re.compile(r"\b(?:[A-ZÀ-Þ]+(?:['’-][A-ZÀ-Þ]+)*[\s,.;:!?¿0-9]+){4,}[A-ZÀ-Þ]+\b")
#: Token classes: function words of each language, lower-case, capitalised and upper-case words, digits, codes, marks of prose, other marks, item marks, marks that join, repeats, the end of a sentence at the end of the line.
TOKENS = len(_LANGUAGES) + 11
CHARS = 8  # lower, upper, digit, prose mark, other mark, kana, Han, blank
#: Words that a repeat may be away from the word it repeats.
NEAR = 12
#: Characters below which a line is judged together with its neighbours.
SHORT = 30


def _char_class(c: str) -> int:
    if c.isspace():
        return 7
    if "぀" <= c <= "ヿ":
        return 5
    if "㐀" <= c <= "鿿":
        return 6
    if c.isalpha():
        return 0 if c.islower() else 1
    return 2 if c.isdigit() else 3 if c in _PROSE_MARKS else 4


_CLASS = np.array([_char_class(chr(k)) for k in range(65536)], np.int64)
_WEIGHT = np.array([1, 1, 1, 1, 1, 3, 3, 1.0])  # a character of these scripts says as much as three letters


def lines_of(text: str) -> list[str]:
    """The lines that aren't blank, freed of quotation marks at their start and of emphasis; words in capitals in a row are put in lower case, and
    one that goes on with the sentence of the line before is joined to it."""
    out: list[str] = []
    for raw in text.split("\n"):
        line = _QUOTE.sub("", raw)
        if not line or line.isspace():
            continue
        if "**" in line or "__" in line or "`" in line:
            line = _EMPHASIS.sub(r"\2", line)
        if _LOUD.search(line):
            line = _SHOUTED.sub(lambda m: m[0].lower(), line)
        if out and line[0].islower() and len(out[-1]) >= SHORT and out[-1].count(" ") > 2 and (out[-1][-1].isalnum() or out[-1][-1] == ",") and line[-1] not in ":;{" and " " in line and not _MARK.match(line) and not _MARK.match(out[-1]):
            out[-1] += " " + line
        else:
            out.append(line)
    return out


def described(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distributions of the tokens and of the characters of each line, and its number of non-blank characters."""
    n = len(_LANGUAGES)
    t = np.zeros((len(lines), TOKENS))
    for own, line in zip(t, lines, strict=True):
        row = [0.0] * TOKENS
        seen: dict[str, int] = {}
        words, end = 0, len(line)
        for m in _TOKEN.finditer(line):
            w = m[0]
            if w[0].isalnum() or w[0] == "_":
                words += 1
                langs = _OF.get(w.lower())
                if langs is not None:
                    for k in langs:
                        row[k] += 1 / len(langs)
                    continue
                before, seen[w] = seen.get(w, -NEAR - 1), words
                if words - before <= NEAR:
                    row[n + 9] += 1
                elif w.isalpha() or "-" in w or "'" in w or "’" in w:
                    row[n if w.islower() else n + 2 if len(w) > 1 and w.isupper() else n + 1] += 1
                elif w.isdigit():
                    row[n + 3] += 1
                else:
                    row[n + 4] += 1
                continue
            a, b = m.span()
            if w[0] in "([{" and b - a > 1:
                row[n + 6] += min(len(w), 4)
                continue
            joins = a > 0 and b < end and line[a - 1] != " " and line[b] != " " and not (line[a - 1].isdigit() and line[b].isdigit())
            if joins and w not in "'’-":
                row[n + 8] += 1
            elif len(w) <= 3 and _PROSE_MARKS.issuperset(w):
                row[n + 5] += 1
            else:
                row[n + 6] += min(len(w), 4)
        if _MARK.match(line):
            row[n + 7] += 2 if line.rstrip()[-1:] in _END else 4
        row[n + 6] += line.count("\t")
        if line.rstrip("\"'”’)»* ")[-1:] in _END:
            row[n + 10] += 2
        own[:] = row
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    c = np.bincount(at * CHARS + _CLASS[np.minimum(points, 65535)], minlength=len(lines) * CHARS).reshape(-1, CHARS)
    size = c[:, :7].sum(1)
    c = c * _WEIGHT
    return t / np.maximum(t.sum(1, keepdims=True), 1e-9), c / np.maximum(c.sum(1, keepdims=True), 1e-9), size


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of each row of ``p`` from each row of ``q``."""
    return _entropy((p[:, None] + q[None]) / 2) - (_entropy(p)[:, None] + _entropy(q)[None]) / 2


def profiles() -> tuple[np.ndarray, np.ndarray]:
    """Mean distributions of every profile's examples."""
    each = [described(EXAMPLES[p]) for p in PROFILES]
    return np.array([t.mean(0) for t, _, _ in each]), np.array([c.mean(0) for _, c, _ in each])


class Classifier:
    """Nearest profiles of texts."""

    def __init__(self):
        self.tokens, self.chars = profiles()

    def lines(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Non-blank characters, profile and divergence of each line that isn't blank."""
        own = lines_of(text)
        if not own:
            return np.zeros(0), np.zeros(0, int), np.zeros(0)
        t, c, size = described(own)
        d = divergence(t, self.tokens) + divergence(c, self.chars)
        short = np.flatnonzero(size < SHORT)
        if len(short) and len(own) > 1:
            w = np.pad(size.astype(float), 1)
            padded = np.pad(d, ((1, 1), (0, 0)))
            both = w[short] + w[short + 2]
            near = (padded[short] * w[short, None] + padded[short + 2] * w[short + 2, None]) / np.maximum(both, 1)[:, None]
            d[short] = np.where((both > 0)[:, None], (d[short] + near) / 2, d[short])
        return size, d.argmin(1), d.min(1)

    def text(self, text: str) -> tuple[str, float, float]:
        """Nearest profile by characters, share of characters outside prose, mean divergence."""
        size, profile, far = self.lines(text)
        total = size.sum()
        if not total:
            return "empty", 0.0, 0.0
        by = np.bincount(profile, size, len(PROFILES))
        prose = sum(by[k] for k, p in enumerate(PROFILES) if p.startswith("prose"))
        return PROFILES[int(by.argmax())], float(1 - prose / total), float((size * far).sum() / total)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Classifier()
    for b in batches:
        rows = [own.text(t) for t in b.column("text").to_pylist()]
        made = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())]
        kept = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], [*kept, "profile", "outside", "divergence"])


def structure(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, profile, outside, divergence): nearest profile, share of non-blank characters outside running
    sentences, and the mean divergence from the profiles. Null texts are left out; a text without any non-blank
    character has the profile ``empty`` and share 0. ``keep``: columns that are handed on behind doc_id."""
    base = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    return base.mapInArrow(_profile, f"{fields}, profile string, outside double, divergence double")


def counts(text: Column) -> dict[str, Column]:
    """Word count, mean word length, symbol ratio, share of lines ending in punctuation, share of common words.
    For a text without words, lines or characters the ratios are 0."""
    w = words(text)
    n = F.size(w)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    ended = F.filter(lines, lambda x: x.rlike(r"[.!?…。！？][\"'”’)\]» ]*$"))
    ratio = lambda a, b: F.round(F.when(b > 0, a.cast("double") / b).otherwise(0.0), 6)
    return {
        "word_count": n.cast("long"),
        "mean_word_length": ratio(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), n),
        "symbol_ratio": ratio(F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")), F.length(text)),
        "punctuated_lines": ratio(F.size(ended), F.size(lines)),
        "common_words": ratio(F.size(F.filter(w, lambda x: x.isin(COMMON))), n),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, word_count, mean_word_length, symbol_ratio, punctuated_lines, common_words) of every document;
    null texts count as empty, rows are kept as they are, other columns are left out."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in counts(text).items()))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't prose."""
    return structure(table(spark, sf_dir, "documents")).where("outside > 0.5").select("doc_id").distinct()


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic statistics of every document."""
    return statistics(table(spark, sf_dir, "documents")).distinct()


def p9_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic statistics with the nearest profile and the verdict, in one pass over the texts; a null text counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stats = counts(F.col("text"))
    s = structure(docs, *(c.alias(k) for k, c in stats.items()))
    return s.select("doc_id", *stats, "profile", F.round("outside", 6).alias("outside"), F.round("divergence", 6).alias("divergence"), (F.col("outside") <= 0.5).alias("is_prose")).distinct()
