"""Counters: spellings, readings after numbers, day readings and suffixes."""

from __future__ import annotations

from dataclasses import dataclass, field

# Counter, reading, kana spellings.
_COUNTERS = """\
個 コ こ
人 ニン にん
台 ダイ だい
冊 サツ さつ
杯 ハイ はい
回 カイ かい
階 カイ かい
円 エン えん
年 ネン ねん
週 シュウ しゅう
秒 ビョウ びょう
号 ゴウ ごう
番 バン ばん
本 ホン ほん ぼん ぽん
匹 ヒキ ひき びき ぴき
枚 マイ まい
歳 サイ さい
才 サイ さい
月 ゲツ
ヶ月 カゲツ
カ月 カゲツ
日 ニチ
時間 ジカン
分 フン
つ ツ つ
"""

# Readings of a number with a counter, where sounds change.
_SOUNDS = {
    "個": "イチ=イッコ ロク=ロッコ ハチ=ハッコ ジュウ=ジュッコ",
    "回": "イチ=イッカイ ニ=ニカイ サン=サンカイ ヨン=ヨンカイ ゴ=ゴカイ ロク=ロッカイ ナナ=ナナカイ ハチ=ハッカイ キュウ=キュウカイ",
    "階": "イチ=イッカイ ニ=ニカイ サン=サンガイ ヨン=ヨンカイ ゴ=ゴカイ ロク=ロッカイ ナナ=ナナカイ ハチ=ハッカイ キュウ=キュウカイ",
    "本": "イチ=イッポン ニ=ニホン サン=サンボン ヨン=ヨンホン ゴ=ゴホン ロク=ロッポン ナナ=ナナホン ハチ=ハッポン キュウ=キュウホン",
    "匹": "イチ=イッピキ ニ=ニヒキ サン=サンピキ ヨン=ヨンヒキ ゴ=ゴヒキ ロク=ロッピキ ナナ=ナナヒキ ハチ=ハッピキ キュウ=キュウヒキ",
    "分": "イチ=イップン ニ=ニフン サン=サンプン ヨン=ヨンプン ゴ=ゴフン ロク=ロップン ナナ=ナナフン ハチ=ハップン キュウ=キュウフン",
}

# Days of the month by the reading of their number; suffixes that may follow a counter.
DAYS = {"イチ": "ツイタチ", "ニ": "フツカ", "サン": "ミッカ", "ヨン": "ヨッカ", "ゴ": "イツカ", "ロク": "ムイカ", "ナナ": "ナノカ", "ハチ": "ヨウカ", "キュウ": "ココノカ", "ジュウ": "トウカ", "ニジュウ": "ハツカ"}
SUFFIXES = ("後", "間", "目", "以内", "以上", "未満", "程度", "くらい", "頃", "前")


@dataclass(frozen=True)
class Counter:
    surface: str
    reading: str
    spellings: tuple[str, ...] = ()
    sounds: dict[str, str] = field(default_factory=dict, hash=False)

    def after(self, number: str) -> str:
        """Reading of a number (as its own reading) with this counter."""
        return self.sounds.get(number, number + self.reading)


def _counters() -> tuple[Counter, ...]:
    rows = (line.split() for line in _COUNTERS.splitlines())
    return tuple(Counter(c, reading, tuple(kana), dict(x.split("=") for x in _SOUNDS.get(c, "").split())) for c, reading, *kana in rows)


COUNTERS = _counters()
_BY_SURFACE = {c.surface: c for c in COUNTERS}


def with_surface(surface: str) -> tuple[Counter, ...]:
    """Counters written so, in their own or in a kana spelling."""
    return tuple(c for c in COUNTERS if surface == c.surface or surface in c.spellings)


def resolve(surface: str, normalized: str | None = None, dictionary_form: str | None = None) -> Counter | None:
    """The counter of a normalized form, else of a dictionary form, else the first written so."""
    for form in (normalized, dictionary_form):
        if form in _BY_SURFACE:
            return _BY_SURFACE[form]
    return next(iter(with_surface(surface)), None)
