"""Small dimension values used by rules, as literals or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signs of Chinese and English punctuation, digits, brackets.
SYMBOLS = ",，.。！!？?：:；;…"
ZH_DIGITS = "零一二三四五六七八九"
ZH_TO_EN = {"，": ",", "。": ".", "？": "?", "‘": "'", "’": "'", "“": '"', "”": '"', "：": ":"}
BRACKETS = (("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"), ("{", "}"), ("《", "》"), ("“", "”"))
FULL_WIDTH = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
HALF_WIDTH = "".join(chr(0x41 + i) for i in range(26)) + "".join(chr(0x61 + i) for i in range(26))
CYRILLIC = "АВЕКМНОРСТУХаеорсух"
CYRILLIC_ASCII = "ABEKMHOPCTYXaeopcyx"
#: Subjects whose records are checked as English.
ENGLISH = ("english",)


def narrow(col: Column) -> Column:
    """Full-width Latin letters to ASCII."""
    return F.translate(col, FULL_WIDTH, HALF_WIDTH)


def pinyin_syllables() -> list[str]:
    """Syllables from initials and finals by the spelling rules of pinyin, tones left out."""
    finals = {
        "": "a o e ai ei ao ou an en ang eng er yi ya yo ye yao you yan yin yang ying yong wu wa wo wai wei wan wen wang weng yu yue yuan yun",
        "b p": "a o ai ei ao an en ang eng i iao ie ian in ing u",
        "m f": "a o ei ou an en ang eng u",
        "m": "e ai ao i iao ie iu ian in ing",
        "d t": "a e ai ei ao ou an ang eng ong i iao ie ian ing u uo ui uan un",
        "d": "en ia iu",
        "n l": "a e ai ei ao ou an ang eng ong i iao ie iu ian in iang ing u uo uan un v ve",
        "n": "en",
        "l": "o ia",
        "g k h": "a e ai ei ao ou an en ang eng ong u ua uo uai ui uan un uang",
        "j q x": "i ia iao ie iu ian in iang ing iong u ue uan un",
        "zh ch sh r z c s": "e i ou an en ang eng u uo ui uan un",
        "zh ch sh z c s": "a ai ao",
        "r": "ao ong",
        "zh ch z c s": "ong",
        "zh sh z": "ei",
        "zh ch sh": "ua uai uang",
    }
    return sorted({i + f for heads, tails in finals.items() for i in (heads.split() or [""]) for f in tails.split()})


def bracket_table(spark: SparkSession) -> DataFrame:
    """``kind, left, right`` of the bracket pairs."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(BRACKETS)], "kind int, left_sign string, right_sign string")
