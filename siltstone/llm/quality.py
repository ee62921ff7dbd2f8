"""Per-document text statistics, and prose told from lists, tables and junk by a Gaussian mixture."""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX2, mix, ship, starts, written

KINDS = ("prose", "list", "table", "junk")
#: Features of a passage, in the order of the mixture's columns.
FEATURES = ("common", "variety", "symbols", "digits", "capitals", "word_length", "illegible", "breaks", "cells", "punctuation")
#: Passages are about so many tokens; a line of LINE tokens or more is never joined to its neighbours.
PASSAGE, LINE, SPLIT = 14, 11, 34
#: Prior of a component's covariance: SPREAD times the identity, with the weight of SHRINK average components.
SHRINK, SPREAD = 1.0, 0.3

_STRIP = "\"'“”‘’«»„‚‹›「」『』()[]{}<>.,;:!?…¿¡。、！？，؟،؛-–—*•·"
_END = re.compile(r"[.!?…。！？؟;·]+[\"'”’»)\]」』]*$")
_PART = re.compile("['’\\-‐‑]")
# Letters (without marks) that carry a syllable in the scripts that write vowels.
_VOWELS = frozenset("aeiouyæœøıəɛɔ" "аеиоуыэюяієѣўөү" "αεηιουω")
# Closed-class words of further languages, beside the table of common words.
CLOSED = {
    "ar": "في من على إلى أن كان هذا هذه التي الذي لم لا ما هو هي عن مع بعد",
    "cs": "se na že je v to jako ale které jsou byl podle",
    "el": "και το η ο να του της τα την των με που από για δεν είναι στο",
    "fi": "ja on ei että se oli hän mutta kun jos niin kuin",
    "he": "של את על לא הוא היא כי גם עם זה אל היה",
    "hu": "a az és hogy nem is egy volt ez de mert csak már még meg aki ha után",
    "it": "il di che la è un per non una sono con del ma come più nel",
    "nl": "de het een van en dat niet is op te met voor er maar die",
    "pl": "i w się na nie że do to jest z jak był ale po",
    "pt": "o de que e do da em um para não uma os com mas",
    "ro": "și în de la cu nu că este pe un o care din",
    "sv": "och att det som en på är av för med den till inte",
    "tr": "bir ve bu da de için ile çok ne ama daha olan gibi",
    "vi": "và của là có không được một cho trong người những đã",
}
# Scripts without blanks between words, and how their grammatical parts are known.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff]")
_PIECES = re.compile("(?:[\u3041-\u309f]+|[\u30a0-\u30ff]+|[\u3400-\u9fff]{1,2}|[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]{1,5}|[^\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff。、！？，]+)[。、！？，]*|[。、！？，]+")
_GRAMMAR = {
    "ja": re.compile("^[\u3041-\u309f]+$"),
    "ko": re.compile("[\uac00-\ud7a3](?:은|는|이|가|을|를|에|의|도|로|와|과|고|서|다|한|며|면|지|요|까|던|들)$"),
    "th": re.compile("ที่|และ|ของ|เป็น|ใน|ไม่|ได้|ว่า|การ|มี"),
    "zh": re.compile("[的是在了不有和这這也就他她我们們与與为為着地得]"),
}
_CELL = re.compile("\t|\\|| {3,}|;|»|>|,(?=\\S)")


class _Tokens(dict):
    """token -> row of the feature table; languages are bits of the common-word mask."""

    def __init__(self, common: dict[str, int], grammar: list[tuple[re.Pattern, int]]):
        super().__init__()
        self.common, self.grammar, self.rows = common, grammar, []
        self.masks: dict[int, int] = {0: 0}

    def __missing__(self, token: str) -> int:
        core = token.strip(_STRIP)
        low = core.lower()
        mask = self.common.get(low, 0)
        if not mask and ("'" in low or "’" in low or "-" in low):
            for part in _PART.split(low):
                mask |= self.common.get(part, 0)
        if not mask and core > "\u0e00":
            for pattern, bit in self.grammar:
                if pattern.search(core):
                    mask |= bit
        if core.isalpha():
            letters, digits = len(core), 0
        elif core.isdecimal():
            letters, digits = 0, len(core)
        else:
            letters = sum(c.isalpha() or unicodedata.category(c) in ("Mn", "Mc") for c in core)
            digits = sum(c.isdigit() for c in core)
        signs = 0
        if letters + digits < len(core) or len(core) < len(token):
            signs = sum(not (c.isalnum() or c in _STRIP or unicodedata.category(c) in ("Mn", "Mc")) for c in token)
        word = letters > 0 and letters >= digits
        inner = len(core) - letters - digits - sum(c in "'’-‐‑\u200c\u200d" for c in core)
        bad = word and (inner > 0 or digits > 0 or len(low) > 22 or (letters > 2 and not spoken(low))) or "�" in token or (not word and not digits and len(token) > 2)
        dense = 1 + (core >= "\u3041") * (0.5 if core < "\u3100" else 1.0)  # a syllable or word sign stands for more letters
        self.rows.append(
            (
                self.masks.setdefault(mask, len(self.masks)), float(word), float(letters + digits > 0), signs / max(1, len(token)), float(digits > letters), float(word and core[:1].isupper() and not (len(core) > 1 and core.isupper())),
                float(letters * dense if word else 0), float(bool(bad)), float(bool(_END.search(token))), float(hash_small(low) if mask else 0),
            )
        )
        i = self[token] = len(self.rows) - 1
        return i


def spoken(word: str) -> bool:
    """Whether a lower-case word can be read: one in Latin, Greek or Cyrillic letters has a vowel; other scripts are taken as they are."""
    letters = [c for c in unicodedata.normalize("NFD", word) if c.isalpha()]
    return any(c in _VOWELS for c in letters) or any("\u0530" <= c < "\u1e00" or c >= "\u2000" for c in letters)


def hash_small(word: str) -> int:
    h = 7
    for c in word:
        h = (h * 131 + ord(c)) & 0xFFFFF
    return h + 1


def passages(lines: list[list[str]]) -> list[tuple[int, int, int]]:
    """(first token, end token, line breaks inside) of each passage of tokenised lines."""
    out: list[tuple[int, int, int]] = []
    at, held, breaks = 0, 0, 0

    def close(end: int) -> None:
        nonlocal held, breaks
        if held:
            out.append((end - held, end, breaks))
        held = breaks = 0

    for tokens in lines:
        n = len(tokens)
        if not n:
            continue
        if n >= LINE:
            close(at)
            parts = max(1, round(n / PASSAGE)) if n >= SPLIT else 1
            edges = [round(n * i / parts) for i in range(parts + 1)]
            out += [(at + a, at + b, 0) for a, b in zip(edges, edges[1:])]
        else:
            held += n
            breaks += 1
        at += n
        if held >= PASSAGE:
            close(at)
    if held and held < 6 and out and out[-1][2]:
        a, _, b = out.pop()
        out.append((a, at, b + breaks))
    else:
        close(at)
    return out


class Measure:
    """Turns texts into passages with features and per-document statistics."""

    def __init__(self, common: dict[str, int], languages: list[str]):
        grammar = [(p, 1 << languages.index(c)) for c, p in _GRAMMAR.items()]
        self.tokens, self.languages, self.common = _Tokens(common, grammar), languages, common
        self.table = np.zeros((0, 10))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document of each passage, word count of it, features, statistics of each document)."""
        if len(self.tokens) > 1_500_000:
            self.__init__(self.common, self.languages)
        every: list[str] = []
        doc, begin, end, breaks, cells = [], [], [], [], []
        line_n, line_end = np.zeros(len(texts)), np.zeros(len(texts))
        count = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            raw = t.splitlines()
            split = [x.split() for x in raw]
            if _UNSPACED.search(t):
                split = [[p for w in x for p in (_PIECES.findall(w) if _UNSPACED.search(w) else (w,))] for x in split]
            base = len(every)
            for tok in split:
                every += tok
                if tok:
                    line_n[i] += 1
                    line_end[i] += bool(_END.search(tok[-1]))
            count[i] = len(every) - base
            marks = [0, *itertools.accumulate(map(len, split))]
            per = [len(_CELL.findall(x.strip())) for x in raw]
            for a, b, k in passages(split):
                doc.append(i)
                begin.append(base + a)
                end.append(base + b)
                breaks.append(k)
                lo, hi = bisect.bisect_right(marks, a) - 1, bisect.bisect_left(marks, b)
                whole = marks[hi] - marks[lo] if hi < len(marks) else b - a
                cells.append(sum(per[lo:hi]) * (b - a) / max(1, whole))
        code = np.fromiter(map(self.tokens.__getitem__, every), np.int64, len(every))
        if len(self.table) < len(self.tokens.rows):
            self.table = np.concatenate([self.table, np.array(self.tokens.rows[len(self.table) :])])
        stats = np.zeros((len(texts), 8))
        if not len(every):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES))), stats
        f = self.table[code]
        off = starts(count)
        mask = f[:, 0].astype(np.int64)
        sums = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[off])
        kinds = len(self.tokens.masks)
        of = np.repeat(np.arange(len(texts)), count)
        bits = (np.array(list(self.tokens.masks))[:, None] >> np.arange(len(self.languages))) & 1
        best = (np.bincount(of * kinds + mask, minlength=len(texts) * kinds).reshape(-1, kinds) @ bits).argmax(1)
        hit = bits[mask, best[of]].astype(float)
        p = np.array(begin), np.array(end)
        cum = lambda v: (lambda c: c[p[1]] - c[p[0]])(np.concatenate([[0.0], np.cumsum(v)]))
        n = (p[1] - p[0]).astype(float)
        w = np.maximum(cum(f[:, 1]), 1)
        seen = f[:, 9] * hit
        variety = np.array([len(set(seen[a:b].tolist()) - {0.0}) for a, b in zip(begin, end)]) / w
        x = np.stack(
            [cum(hit) / w, variety, cum(f[:, 3]) / n, cum(f[:, 4]) / n, cum(f[:, 5]) / w, np.minimum(cum(f[:, 6]) / w, 15), cum(f[:, 7]) / n, np.array(breaks) / n, np.minimum(np.array(cells) / n, 3), cum(f[:, 8]) / n], 1
        )
        m = np.maximum(count, 1)
        total = sums(f[:, 1])
        stats[:] = np.stack([sums(f[:, 2]), sums(f[:, 6]) / np.maximum(total, 1), sums(f[:, 3]) / m, sums(f[:, 4]) / m, line_end / np.maximum(line_n, 1), sums(hit) / np.maximum(total, 1), sums(f[:, 7]) / m, line_n], 1)
        return np.array(doc, np.int64), cum(f[:, 2]).astype(np.int64), x, stats


# Inspected examples: a kind and a text that was read and judged.  They name the components; they neither start the fit nor weigh in it.
EXAMPLES = [
    ("prose", "The river rose slowly after the storm, and by morning the lower fields were under water. People from the village moved their animals to the hill."),
    ("prose", "When you heat the metal, it expands a little, which is why the bridge has gaps between its plates. Many of these gaps are covered in winter."),
    ("prose", "nobody in the town knew that the old clock could still be repaired\nuntil a visitor from the coast\nopened it and showed them how each wheel\nmoves the next one"),
    ("prose", "we waited for them until the lamps were lit, but none of the boats that had left in the morning came back to the harbour before it was dark"),
    ("prose", "1. Most people believe that the stars are small, but they are only very far away.\n2. If it rains after this, the roots can hold more water than they did before."),
    ("prose", "a) You must first let the clay dry in the shade.\nb) Then it is fired for two days.\nc) Do not open the door before it is cold, or all of it will crack."),
    ("prose", "- The mill was built in 1804 by two brothers from the coast.\n- It burned down twice, and each time they built it again.\n- Nobody knows who owned it after that."),
    ("prose", "> \"I never saw a wall like this,\" said the mason, \"and I have seen most of them.\"\n> \"Then you have not been to our valley,\" she answered."),
    ("prose", "EACH OF THE PILOTS MUST LEARN TO READ THE WIND BEFORE THE FIRST FLIGHT. IN SHORT, THERE IS NO WAY AROUND IT."),
    ("prose", "If p = 12 and q = 30, then p + q = 42, and the rule of Holt holds for all 9 pairs (see Brandt, 1911)."),
    ("prose", "For n = 7 and m = 4 we get n - m = 3, so that the law of Sanders is true for each of the 15 cases (see Albrecht, 1876)."),
    ("prose", "Let x be 25 and y be 16. Then x + y = 41, which is why 41 of the 60 squares (see Moritz, 1902) stay empty."),
    ("prose", "It took the miller nine years to build the second\nwheel, and when it was done nobody could say why\nthe water did not turn it. Many of those who came\nto see it left before the evening."),
    ("prose", "The first plan was to move it to the other side of\n\nthe valley, but each of the stones was too heavy for\n\nthe carts that they had in 1804. If you walk there today,\n\nyou can still find the marks of the wheels."),
    ("prose", "In 1822 the people of Holt built 40\nbridges to reach their new market Most\nvisitors learn to cross the river before\nthey see the town As Brandt put it, the\nwall is high but the gates are open"),
    ("prose", "The school at Marlow keeps 512\n\nold maps of the coast Neither the paper\n\nnor the ink is weakened by the damp\n\nToday the children of Holt use fewer\n\nmaps than they did in 1850"),
    ("prose", "Albrecht and Moritz drew the northern\ncoast of Brenn and counted its rocks\nWhat would happen to the boats if every\nrock were marked? Some masters believe\nthat it would help only a little"),
    ("prose", "Sanders drew 25 plans of the tower, and\nno two of them were alike In 1733 half of\nthe stones of Marlow were sold, and the\nrest of them still lie near the river"),
    ("prose", "Depuis trois ans, la petite école du village accueille des enfants qui viennent de la montagne, mais elle est trop étroite pour tous. Selon le maire, il faut en construire une autre."),
    ("prose", "Cette maison n'est pas grande, mais elle\nest assez claire pour que les enfants\npuissent y lire jusqu'au soir. Selon eux,\nil y a plus de 30 livres."),
    ("prose", "En 1712 les habitants de Brenn ont\nconstruit un pont pour leurs voisins La\nplupart des marins pensent que le phare\nn'est pas assez haut"),
    ("prose", "Seit dem Winter ist die alte Brücke über den Fluss nicht mehr offen, und die Schüler gehen nun auf dem langen Weg nach Hause. Warum sie brach, weiß bis heute keiner."),
    ("prose", "Für die Kinder aus dem Dorf war der Garten im Jahr 1910 ganz neu. Wer die Mauer kennt, findet dort noch heute 12 Namen von Arbeitern."),
    ("prose", "Im Herbst 1802 baute Merrow eine lange Mauer zwischen Ashmoor und dem See. Nach ihm wurde auch die Straße benannt, obwohl er nie dort wohnte."),
    ("prose", "Der Weg über den Berg ist im Winter\nnicht offen, und wer ihn trotzdem geht,\nmuss mit dem Schnee und dem Wind rechnen."),
    ("prose", "La estación de Westley recibió a 40 viajeros en el año 1921. ¿Por qué el tren de Merrow no llegó a la plaza del pueblo?"),
    ("prose", "Según los vecinos, la lluvia de este año fue más fuerte que la del año pasado, pero nadie perdió su casa. También se salvaron los árboles de la plaza."),
    ("prose", "Los barcos que salen del puerto por la\nmañana no vuelven hasta la noche, y por\neso nadie los espera en la playa"),
    ("prose", "В старом доме на берегу реки жил учитель, который знал все песни этого края. Он не был богат, но у него всегда были гости."),
    ("prose", "В 1840 году жители города построили\nмост через реку, но весной вода его\nунесла Никто не знает, почему он не\nвыдержал"),
    ("prose", "Οι άνθρωποι του χωριού δεν ήξεραν από πού έρχεται το νερό, και γι' αυτό έχτισαν ένα μικρό τοίχο κοντά στην πηγή. Από τότε δεν έχει πλημμυρίσει."),
    ("prose", "A régi malom már nem működik, de a falu lakói még mindig emlékeznek rá. Azt mondják, hogy egy nagy vihar után senki sem javította meg."),
    ("prose", "ذهب الرجل إلى السوق في الصباح ولم يجد أحدا هناك. بعد ذلك عاد إلى البيت وهو لا يعرف ما الذي كان قد حدث في المدينة."),
    ("prose", "昔この村には大きな水車がありました。しかし川の流れが変わったので、今ではだれもそれを使っていません。子どもたちはそこで遊びます。"),
    ("prose", "옛날에 이 마을에는 큰 물레방아가 있었다. 그러나 강의 흐름이 바뀌어서 지금은 아무도 그것을 쓰지 않는다. 아이들은 거기에서 논다."),
    ("prose", "这个村子里的人都知道那座桥的故事。他说桥是在很久以前修的，但是没有人记得是谁修的。"),
    ("prose", "De oude molen aan de rivier werd in de winter niet gebruikt, maar de boeren van het dorp hielden hem toch in goede staat."),
    ("list", "Home | About us | Contact | Shop\nOpening hours (Mon - Fri)\nNewsletter\nBasket (3) | Wish list (0)\nSign in | Register"),
    ("list", "- Copper kettles\n- Bowls of Ashmoor (1780)\n- Cups, plain and painted\n- Silver spoon\n- Trays of Westley\n- Glass, blown and cut"),
    ("list", "01 - Lamps of Kerrowick (1702)\n02 - Small lamp\n03 - Lanterns, brass and tin\n04 - Wicks of Dunmere\n05 - Candles, long and short"),
    ("list", "1. Lamps of Kerrowick (1702)\n2. Bowls, painted and plain\n3. Lanterns, brass and tin\n4. Small lamp\n5. Wicks of Dunmere (1811)\n6. Candles, long and short"),
    ("list", "1. Bowls, painted and plain\n2. Lanterns, brass and tin\n3. Candles, long and short\n4. Kettles of Ashmoor (1690)"),
    ("list", "Lanterns, brass and tin\nSmall lamp\nWicks of Dunmere (1811)\nCandles, long and short\nLamps, old and new\nKettles of Ashmoor\nPainted bowl"),
    ("list", "• Copper kettles of Ashmoor\n• Bowls, painted and plain\n• Lanterns of Westley\n• Candles, long and short\n• Spoons of Holt"),
    ("list", "a) Silver spoon\nb) Kettles of Ashmoor (1780)\nc) Trays, plain and painted\nd) Copper bowl\ne) Lamps of Westley (1699)"),
    ("list", "Silver spoon ........ 12.50\nCopper bowl ...... 104.00\nBrass lamp ............ 33.75\nPainted cup .... 8.20"),
    ("list", "Ashmoor (copper), Westley (silver), Dunmere (brass), Kerrowick (tin), Stanmere (glass) and Holt (clay), 1702, 1811"),
    ("list", "Ashmoor: Brindel kettle;\nWestley: Corvane bowl,\nDunmere: Haldric spoon\nKerrowick: Élan cup;\nStanmere: Jorvec tray"),
    ("list", "painted bowls ashmoor, silver spoons westley, copper kettles dunmere, plain cups kerrowick, brass lamps stanmere, blown glass holt"),
    ("list", "Silver spoon » Cups, plain and painted » Kettles of Ashmoor » Small tray » Glass, cut and blown » Brass lamp"),
    ("list", "Contents\nThe Silver Spoon and the Kettles of Ashmoor\nWhy the Copper Kettle matters: Bowls at Westley\nLesson: Painted Cup, Trays and Dunmere"),
    ("list", "Brindel, 12, 45, 79\nCorvane, 3, 18, 220\nHaldric, 9, 57\nJorvec, 101, 144, 160\nMerrow, 8"),
    ("list", "銅のやかん\n青い茶碗\n木の盆\n銀匙\n硝子杯\n竹籠"),
    ("table", "Kettle\tBowl\tSpoon\tCup\nAshmoor\t441\t12.90\t7345\nWestley\t8831\t77\t320.10\nDunmere\t65\t901\t4"),
    ("table", "| Kettle | Bowl | Spoon |\n| --- | --- | --- |\n| Ashmoor | 441 | 12.9 |\n| Westley | 88 | Corvane |\n| 31 | 77 | 902 |"),
    ("table", "Kettle,Bowl,Spoon,Cup\nAshmoor,44123,Brindel,901\nWestley,883,77.4,Corvane\nDunmere,19002,56,3.5"),
    ("table", "Kettle      Bowl       Spoon      Cup\nAshmoor     44123      901        12.5\nWestley     883        Corvane    77\nDunmere     190        4          Haldric"),
    ("table", "Ashmoor 3 - 1 Westley\nDunmere 0 - 0 Kerrowick\nStanmere 2 - 5 Holt\nWestley 4 - 4 Dunmere"),
    ("junk", "qzrt bnxk plmw trrv zzkq mnbv xcvl kjhg qwrt ppld zxcv bnmk rtyq wplk"),
    ("junk", "&xkq;&#4410;<bz rtk=\"wq\"/>%3f%aa\n&plm;&#881;<zx qq=\"nn\"/>%0d%b1\n&trw;&#7;<m kk=\"vv\"/>%9c%1e"),
    ("junk", "#@}{~|^<> ;%$!_[]=* -}{|~ ^%$#@ !&*=_ <>/\\ [}{;\n~^|_ =}{%$ #!@&* ;:<>{}[] \\|/~"),
    ("junk", "function qzx(a,b){ var tr=431; if(mk[7]!=pw){ return zx.qq(); } }\nfunction wk(c){ var nn=90; if(rt!=b){ return k.v(); } }"),
    ("junk", "ashmoor/copper-kettle.html\nqx/silver-spoon-westley.html\nbd/painted-cup.html\ntrk/brass-lamp-dunmere.html"),
    ("junk", "Ð¡Ñ‚Ð°Ñ€Ñ‹Ð¹ Ð´Ð¾Ð¼ ÑÑ‚Ð¾Ð¸Ñ‚ Ð½Ð° Ð±ÐµÑ€ÐµÐ³Ñƒ Ñ€ÐµÐºÐ¸ Ð¸ Ð½Ð¸ÐºÑ‚Ð¾ Ð½Ðµ Ð¶Ð¸Ð²Ñ‘Ñ‚"),
    ("junk", "Th, r|v;r r~se sl0w`y aft,r t|e st~rm, ^nd b. m;rn|ng th, l~w,r fi^lds w.re u`d;r w0t|r ^nd n~b,dy l;ft"),
    ("junk", "Ashmoor westley dunmere kettle kerrowick stanmere holt brindel spoon corvane?\nWestley haldric dunmere ashmoor merrow jorvec bowl stanmere kerrowick!"),
    ("junk", "Holt stanmere merrow kettle brindel jorvec haldric open copper westley.\nDunmere spoon corvane lift kerrowick tray glass ashmoor bowl carve!"),
    ("junk", "kettle mmxz bowl lkwn spoon tray pqrv kettle mmxz cup bowl lkwn kettle mmxz spoon tray pqrv cup kettle"),
    ("junk", "hhhhee\ufffdwk?b\ufffd ccccoh\ufffdl?rr dd?qc?ssrr\ufffd  n\ufffdxcutuuu qizzo\ufffdf?cc\ufffdelp n\ufffdtt\ufffdvvss"),
    ("junk", "spoon spoon spoon spoon spoon spoon spoon spoon kettle kettle kettle kettle kettle kettle kettle"),
]


def _quadratic(z: np.ndarray) -> np.ndarray:
    """1, z and the products z_i z_j (i <= j) of each row: both the densities and the sums of a round are products with these."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], axis=1)


def _coefficients(model: dict) -> np.ndarray:
    """Column j makes the log density of component j, times its weight, from the quadratic terms."""
    d = len(FEATURES)
    i, j = np.triu_indices(d)
    out = np.empty((1 + d + len(i), len(model["weight"])))
    for c, (w, mu, cov) in enumerate(zip(model["weight"], model["mean"], model["cov"])):
        inv = np.linalg.inv(cov)
        lin = inv @ mu
        out[:, c] = np.concatenate([[np.log(w) - 0.5 * (mu @ lin + np.linalg.slogdet(cov)[1] + d * np.log(2 * np.pi))], lin, np.where(i == j, -0.5, -1.0) * inv[i, j]])
    return out


def _shares(q: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = q @ coefficients
    top = d.max(1)
    d -= top[:, None]
    np.exp(d, out=d)
    total = d.sum(1)
    d /= total[:, None]
    return d, top + np.log(total)


def responsibilities(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Share of each component in each row, and each row's log likelihood."""
    return _shares(_quadratic((x - model["centre"]) / model["scale"]), _coefficients(model))


def common_mask(words: DataFrame) -> tuple[dict[str, int], list[str]]:
    """(word -> bit mask of languages, the languages) of the common-word table (a fixed table of words a language, not corpus data) and CLOSED."""
    rows = [(r[0], r[1]) for r in words.select("language", "word").na.drop().distinct().limit(200_000).collect()]
    return word_masks(rows)


def word_masks(rows: list[tuple[str, str]]) -> tuple[dict[str, int], list[str]]:
    rows = [*rows, *((c, w) for c, t in CLOSED.items() for w in t.split())]
    languages = sorted({c for c, _ in rows} | set(_GRAMMAR))
    if len(languages) > 62:
        raise ValueError("more than 62 languages")
    out: dict[str, int] = {}
    for c, word in rows:
        w = unicodedata.normalize("NFC", word).lower()
        out[w] = out.get(w, 0) | 1 << languages.index(c)
    return out, languages


_measures: dict[int, Measure] = {}


def _measure(common: dict[str, int], languages: list[str]) -> Measure:
    """The worker's measure for these words, so that tokens met in one task are known in the next."""
    key = hash((*languages, frozenset(common.items())))
    if key not in _measures:
        _measures.clear()
        _measures[key] = Measure(common, languages)
    return _measures[key]


def measured(docs: DataFrame, key: str, text: str, common: dict[str, int], languages: list[str]) -> DataFrame:
    """(id, stats array<double>, words array<int>, x array<float>): a row per document with visible text; x holds the features of its passages, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _measure(common, languages)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = [unicodedata.normalize("NFC", t) for t in part.column(1).to_pylist()]
                doc, words, x, stats = measure(texts)
                n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
                keep = np.flatnonzero(n > 0)
                at = starts(n)
                s = stats[keep]
                k = len(FEATURES)
                one = pa.array(np.concatenate([at[keep], at[-1:]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel())),
                        pa.ListArray.from_arrays(one, pa.array(words.astype(np.int32))), pa.ListArray.from_arrays(pa.array(np.concatenate([at[keep], at[-1:]]).astype(np.int32) * k), pa.array(x.astype(np.float32).ravel())),
                    ],
                    names=["id", "stats", "words", "x"],
                )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(run, "id bigint, stats array<double>, words array<int>, x array<float>")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(FEATURES))


def _partial(blocks: Iterator[np.ndarray], model: dict | None) -> np.ndarray:
    """Weighted sums of the quadratic terms by component, and the log likelihood at the end, over blocks of passages."""
    d = len(FEATURES)
    k = 1 if model is None else len(model["weight"])
    acc, like = np.zeros((k, 1 + d + d * (d + 1) // 2)), 0.0
    coefficients = None if model is None else _coefficients(model)
    for x in blocks:
        for lo in range(0, len(x), 20_000):
            part = x[lo : lo + 20_000]
            if model is None:
                acc += _quadratic(part).sum(0)
            else:
                q = _quadratic((part - model["centre"]) / model["scale"])
                r, ll = _shares(q, coefficients)
                acc += r.T @ q
                like += ll.sum()
    return np.append(acc.ravel(), like)


def _sums(m: DataFrame, model: dict | None) -> dict[int, np.ndarray]:
    """Sums over all passages of the corpus; they are added up in Spark, so a few thousand numbers arrive at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _partial((_matrix(b.column(0)) for b in batches), model)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    k = 1 if model is None else len(model["weight"])
    got = m.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    return _by_component(got if len(got) else _partial(iter(()), model), k)


def _by_component(flat: np.ndarray, k: int) -> dict[int, np.ndarray]:
    return {-1: flat[-1:], **dict(enumerate(flat[:-1].reshape(k, -1)))}


def _square(terms: np.ndarray) -> np.ndarray:
    """The symmetric matrix of second moments behind the quadratic terms."""
    d = len(FEATURES)
    i, j = np.triu_indices(d)
    out = np.empty((d, d))
    out[i, j] = out[j, i] = terms[1 + d :]
    return out


def example_features(common: dict[str, int], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(kind of each passage of the inspected examples, its features)."""
    doc, _, x, _ = Measure(common, languages)([t for _, t in EXAMPLES])
    return np.array([KINDS.index(EXAMPLES[i][0]) for i in doc]), x


def first_means(z: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of z, each drawn with a chance in proportion to its distance from those drawn before; no example has a part in it."""
    rows = [z[rng.integers(len(z))]]
    far = np.sqrt(((z - rows[0]) ** 2).sum(1))
    for _ in range(k - 1):
        total = far.sum()
        rows.append(z[rng.choice(len(z), p=far / total if total > 0 else None)])
        far = np.minimum(far, np.sqrt(((z - rows[-1]) ** 2).sum(1)))
    return np.stack(rows)


def start_model(centre: np.ndarray, scale: np.ndarray, mean: np.ndarray) -> dict:
    k, d = mean.shape
    return {"centre": centre, "scale": scale, "weight": np.full(k, 1 / k), "mean": mean, "cov": np.stack([np.eye(d) * SPREAD] * k)}


def maximised(model: dict, sums: dict[int, np.ndarray], n: float) -> tuple[dict, float]:
    """The next model from the weighted sums of a round, and the objective of the model that made them: mean log likelihood with the log prior."""
    k, d = model["mean"].shape
    pull = SHRINK * n / k
    prior = sum(np.linalg.slogdet(c)[1] + SPREAD * np.trace(np.linalg.inv(c)) for c in model["cov"])
    objective = sums[-1][0] / n - 0.5 * pull / n * prior + 1e-4 / k * np.log(model["weight"]).sum()
    weight, mean, cov = [], [], []
    for j in range(k):
        r = sums[j][0]
        mu = sums[j][1 : 1 + d] / r if r > 1e-9 * n else model["mean"][j]
        c = (_square(sums[j]) - r * np.outer(mu, mu) + pull * SPREAD * np.eye(d)) / (r + pull)
        weight.append(r + 1e-4 * n / k)
        mean.append(mu)
        cov.append((c + c.T) / 2)
    w = np.array(weight)
    return model | {"weight": w / w.sum(), "mean": np.stack(mean), "cov": np.stack(cov)}, float(objective)


def expectation_maximisation(model: dict, sums, n: float, tolerance: float, most: int) -> dict:
    """Rounds until the objective rises by less than the tolerance; ``sums`` makes a round's sums for a model.

    The result has the objective of every round as ``trace``.  Not settling within ``most`` rounds is an error.
    """
    trace: list[float] = []
    for _ in range(most):
        model, objective = maximised(model, sums(model), n)
        trace.append(objective)
        if len(trace) > 1 and trace[-1] - trace[-2] < tolerance:
            return model | {"trace": trace}
    raise RuntimeError(f"the mixture didn't settle in {most} rounds")


def sampled(m: DataFrame, n: float, rows: int) -> np.ndarray:
    """Features of about so many passages (all, if there are no more), chosen by a hash of document and place."""
    limit = np.uint64(min(rows / max(n, 1.0), 1.0) * (2.0**64 - 2**12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            count = np.diff(b.column(1).offsets.to_numpy()) // len(FEATURES)
            ids = np.repeat(np.asarray(b.column(0)), count)
            place = np.arange(len(ids)) - np.repeat(starts(count)[:-1], count)
            keep = mix((ids.view(np.uint64) * MIX2) ^ place.astype(np.uint64)) <= limit
            x = _matrix(b.column(1))[keep].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(place[keep]), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], names=["id", "place", "x"])

    t = m.select("id", "x").mapInArrow(run, "id bigint, place bigint, x array<float>").toArrow().combine_chunks()
    x = t.column(2).combine_chunks().flatten().to_numpy().astype(float).reshape(-1, len(FEATURES)) if t.num_rows else np.zeros((0, len(FEATURES)))
    return x[np.lexsort((*x.T, t.column(1).to_numpy(), t.column(0).to_numpy()))]


def named(model: dict, kinds: np.ndarray, x: np.ndarray) -> dict:
    """The model with a kind for every component: that of the examples it explains, by their share; else that of the example nearest its mean."""
    r, _ = responsibilities(x, model)
    votes = np.stack([(r[kinds == j] / max(1, (kinds == j).sum())).sum(0) for j in range(len(KINDS))], 1)
    z = (x - model["centre"]) / model["scale"]
    near = kinds[((model["mean"][:, None, :] - z[None]) ** 2).sum(2).argmin(1)]
    return model | {"kind": np.where(votes.max(1) > 1e-3, votes.argmax(1), near)}


def fit(m: DataFrame, common: dict[str, int], languages: list[str], components: int = 40, sample: int = 20_000, restarts: int = 5, tolerance: float = 5e-4, most: int = 300) -> dict:
    """Gaussian mixture over the standardised features of all passages of the corpus, by expectation-maximisation until it settles.

    It starts from rows of a sample of ``sample`` passages, drawn at random: ``restarts`` fits to the sample run until they
    settle, and the best one is where the rounds over all passages begin.  Each of those is one pass over the whole
    table, and the fit ends only when the objective over all passages has settled.  A prior keeps each component's
    covariance from collapsing onto repeated values: as many passages as SHRINK average components hold, spread by SPREAD.
    Components are then named by the inspected examples, which have no part in the fit.
    """
    d = len(FEATURES)
    s = _sums(m, None)[0]
    n = max(s[0], 1.0)
    centre = s[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(np.diag(_square(s)) / n - centre**2, 1e-4))
    kinds, x = example_features(common, languages)
    part = sampled(m, n, sample)
    z = (part - centre) / scale if len(part) else np.zeros((1, d))
    rng = np.random.default_rng(7)
    tries = []
    for _ in range(restarts):
        own = start_model(centre, scale, first_means(z, components, rng))
        tries.append(expectation_maximisation(own, lambda mo: _by_component(_partial(iter([part]), mo), components), max(1.0, float(len(part))), tolerance, most))
    best = max(tries, key=lambda mo: mo["trace"][-1])
    model = expectation_maximisation(best, lambda mo: _sums(m, mo), n, tolerance, most)
    return named(model | {"start_trace": best["trace"]}, kinds, x)


def mixture(spark: SparkSession, model: dict) -> DataFrame:
    """(component, kind, weight, rounds, start_objective, objective): the components, the rounds over all passages, and the objective at their begin and end."""
    rows = [(j, KINDS[int(c)], float(w), len(model["trace"]), model["trace"][0], model["trace"][-1]) for j, (c, w) in enumerate(zip(model["kind"], model["weight"]))]
    return spark.createDataFrame(rows, "component int, kind string, weight double, rounds int, start_objective double, objective double")


def fitted(docs: DataFrame, words: DataFrame, key: str = "source_ord", text: str = "text") -> tuple[DataFrame, dict]:
    """(measured documents, the mixture fitted to them)."""
    ship(docs.sparkSession)
    common, languages = common_mask(words)
    m = written(measured(docs, key, text, common, languages), "passages")
    return m, fit(m, common, languages)


def judged(docs: DataFrame, words: DataFrame, key: str = "source_ord", text: str = "text") -> DataFrame:
    """Statistics and verdict of each document with visible text.

    (key, words, mean_word_length, symbol_ratio, digit_ratio, line_end_share, common_share, illegible_share, lines,
    prose_share, kind): prose_share is the share of words in passages that the mixture holds for prose; kind is the kind of most
    words.  Null and blank texts give no row; a text with signs but no words has prose_share 0.
    """
    m, model = fitted(docs, words, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "common_share", "illegible_share", "lines"]
        for b in batches:
            if not b.num_rows:
                continue
            n = np.diff(b.column(2).offsets.to_numpy())
            x, w = _matrix(b.column(3)), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
            r, _ = responsibilities(x, model)
            by = np.stack([r[:, model["kind"] == j].sum(1) for j in range(len(KINDS))], 1)
            doc = np.repeat(np.arange(len(n)), n)
            share = np.zeros((len(n), len(KINDS)))
            np.add.at(share, doc, by * np.maximum(w, 1e-6)[:, None])
            share /= share.sum(1, keepdims=True)
            stats = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
            cols = [pa.array(stats[:, i].astype(np.int32) if c in ("words", "lines") else stats[:, i]) for i, c in enumerate(names)]
            prose = np.where(stats[:, 0] > 0, share[:, 0], 0.0)
            kind = share.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(prose), pa.array([KINDS[i] for i in kind.tolist()])], names=[key, *names, "prose_share", "kind"])

    return m.mapInArrow(run, f"`{key}` bigint, words int, mean_word_length double, symbol_ratio double, digit_ratio double, line_end_share double, common_share double, illegible_share double, lines int, prose_share double, kind string")
