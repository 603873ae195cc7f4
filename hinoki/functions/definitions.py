"""Packaged definitions, in the notation of the definition files."""

from __future__ import annotations

import unicodedata

# Category rules (name, invoke, group, length), then code points and their categories.
CHARACTERS = """\
DEFAULT 0 1 0
SPACE 0 1 0
KANJI 0 0 2
SYMBOL 1 1 0
NUMERIC 1 1 0
ALPHA 1 1 0
HIRAGANA 0 1 2
KATAKANA 1 1 2
KANJINUMERIC 0 1 0
GREEK 1 1 0
CYRILLIC 1 1 0
0x0020 SPACE
0x000D SPACE
0x0009 SPACE
0x000B SPACE
0x000A SPACE
0x0021..0x002F SYMBOL
0x0030..0x0039 NUMERIC
0x003A..0x0040 SYMBOL
0x0041..0x005A ALPHA
0x005B..0x0060 SYMBOL
0x0061..0x007A ALPHA
0x007B..0x007E SYMBOL
0x00A1..0x00BF SYMBOL
0x00C0..0x00D6 ALPHA
0x00D7 SYMBOL
0x00D8..0x00F6 ALPHA
0x00F7 SYMBOL
0x00F8..0x00FF ALPHA
0x0100..0x017F ALPHA
0x0180..0x0236 ALPHA
0x1E00..0x1EF9 ALPHA
0x0400..0x04F9 CYRILLIC
0x0500..0x050F CYRILLIC
0x0374..0x03FB GREEK
0x3041..0x309F HIRAGANA
0x30A1..0x30FA KATAKANA
0x30FC..0x30FF KATAKANA
0x31F0..0x31FF KATAKANA
0x30A1 NOOOVBOW
0x30A3 NOOOVBOW
0x30A5 NOOOVBOW
0x30A7 NOOOVBOW
0x30A9 NOOOVBOW
0x30E3 NOOOVBOW
0x30E5 NOOOVBOW
0x30E7 NOOOVBOW
0x30EE NOOOVBOW
0x30FB..0x30FE NOOOVBOW
0xFF66..0xFF9D KATAKANA
0xFF9E..0xFF9F KATAKANA
0x2E80..0x2EF3 KANJI
0x2F00..0x2FD5 KANJI
0x3005 KANJI NOOOVBOW
0x3007 KANJI
0x3400..0x4DB5 KANJI
0x4E00..0x9FFF KANJI
0xF900..0xFA2D KANJI
0xFA30..0xFA6A KANJI
0x4E00 KANJINUMERIC KANJI
0x4E8C KANJINUMERIC KANJI
0x4E09 KANJINUMERIC KANJI
0x56DB KANJINUMERIC KANJI
0x4E94 KANJINUMERIC KANJI
0x516D KANJINUMERIC KANJI
0x4E03 KANJINUMERIC KANJI
0x516B KANJINUMERIC KANJI
0x4E5D KANJINUMERIC KANJI
0x5341 KANJINUMERIC KANJI
0x767E KANJINUMERIC KANJI
0x5343 KANJINUMERIC KANJI
0x4E07 KANJINUMERIC KANJI
0x5104 KANJINUMERIC KANJI
0x5146 KANJINUMERIC KANJI
0xFF10..0xFF19 NUMERIC
0xFF21..0xFF3A ALPHA
0xFF41..0xFF5A ALPHA
0xFF01..0xFF0F SYMBOL
0xFF1A..0xFF20 SYMBOL
0xFF3B..0xFF40 SYMBOL
0xFF5B..0xFF65 SYMBOL
0xFFE0..0xFFEF SYMBOL
0x2000..0x206F SYMBOL
0x2070..0x209F NUMERIC
0x20A0..0x20CF SYMBOL
0x20D0..0x20FF SYMBOL
0x2100..0x214F SYMBOL
0x2150..0x218F NUMERIC
0x2100..0x214B SYMBOL
0x2190..0x21FF SYMBOL
0x2200..0x22FF SYMBOL
0x2300..0x23FF SYMBOL
0x2460..0x24FF SYMBOL
0x2501..0x257F SYMBOL
0x2580..0x259F SYMBOL
0x25A0..0x25FF SYMBOL
0x2600..0x26FE SYMBOL
0x2700..0x27BF SYMBOL
0x27F0..0x27FF SYMBOL
0x27C0..0x27EF SYMBOL
0x2800..0x28FF SYMBOL
0x2900..0x297F SYMBOL
0x2B00..0x2BFF SYMBOL
0x2A00..0x2AFF SYMBOL
0x3300..0x33FF SYMBOL
0x3200..0x32FE SYMBOL
0x3000..0x303F SYMBOL
0xFE30..0xFE4F SYMBOL
0xFE50..0xFE6B SYMBOL
0x3007 SYMBOL KANJINUMERIC
0x309B..0x309C HIRAGANA KATAKANA
""".splitlines()

# Unknown-word rules (category, left id, right id, cost, part of speech).
UNKNOWN_WORDS = """\
DEFAULT,5968,5968,3857,補助記号,一般,*,*,*,*
SPACE,5966,5966,6056,空白,*,*,*,*,*
KANJI,5139,5139,14657,名詞,普通名詞,一般,*,*,*
KANJI,5129,5129,17308,名詞,普通名詞,サ変可能,*,*,*
KANJI,4785,4785,18181,名詞,固有名詞,一般,*,*,*
KANJI,4787,4787,18086,名詞,固有名詞,人名,一般,*,*
KANJI,4791,4791,19198,名詞,固有名詞,地名,一般,*,*
SYMBOL,5129,5129,17094,名詞,普通名詞,サ変可能,*,*,*
NUMERIC,4794,4794,12450,名詞,数詞,*,*,*,*
ALPHA,5139,5139,11633,名詞,普通名詞,一般,*,*,*
ALPHA,4785,4785,13620,名詞,固有名詞,一般,*,*,*
ALPHA,4787,4787,14228,名詞,固有名詞,人名,一般,*,*
ALPHA,4791,4791,15793,名詞,固有名詞,地名,一般,*,*
ALPHA,5687,5687,15246,感動詞,一般,*,*,*,*
HIRAGANA,5139,5139,16012,名詞,普通名詞,一般,*,*,*
HIRAGANA,5129,5129,20012,名詞,普通名詞,サ変可能,*,*,*
HIRAGANA,4785,4785,18282,名詞,固有名詞,一般,*,*,*
HIRAGANA,4787,4787,18269,名詞,固有名詞,人名,一般,*,*
HIRAGANA,4791,4791,20474,名詞,固有名詞,地名,一般,*,*
HIRAGANA,5687,5687,17786,感動詞,一般,*,*,*,*
KATAKANA,5139,5139,10980,名詞,普通名詞,一般,*,*,*
KATAKANA,5129,5129,14802,名詞,普通名詞,サ変可能,*,*,*
KATAKANA,4785,4785,13451,名詞,固有名詞,一般,*,*,*
KATAKANA,4787,4787,13759,名詞,固有名詞,人名,一般,*,*
KATAKANA,4791,4791,14554,名詞,固有名詞,地名,一般,*,*
KATAKANA,5687,5687,15272,感動詞,一般,*,*,*,*
KANJINUMERIC,4794,4794,14170,名詞,数詞,*,*,*,*
GREEK,5139,5139,11051,名詞,普通名詞,一般,*,*,*
GREEK,4785,4785,13353,名詞,固有名詞,一般,*,*,*
GREEK,4787,4787,13671,名詞,固有名詞,人名,一般,*,*
GREEK,4791,4791,14862,名詞,固有名詞,地名,一般,*,*
CYRILLIC,5139,5139,11140,名詞,普通名詞,一般,*,*,*
CYRILLIC,4785,4785,13174,名詞,固有名詞,一般,*,*,*
CYRILLIC,4787,4787,13495,名詞,固有名詞,人名,一般,*,*
CYRILLIC,4791,4791,14700,名詞,固有名詞,地名,一般,*,*
""".splitlines()

# Characters kept as they are (Roman numerals, radicals, sound marks, compatibility ideographs).
KEPT_RANGES = ((0x2160, 0x217F), (0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x309B, 0x309C), (0xF900, 0xFA6D), (0xFA70, 0xFAD9))


def kept_characters() -> frozenset[str]:
    return frozenset(chr(c) for low, high in KEPT_RANGES for c in range(low, high + 1))


def voiced_kana() -> dict[str, str]:
    """Kana followed by a sound mark -> the one kana for both.

    Rows う, か, さ, た and は in half width, as hiragana and as katakana, with the half
    width, combining and spacing marks; half width kana take the half width mark only.
    """
    voiced, half_voiced = "うかきくけこさしすせそたちつてとはひふへほ", "はひふへほ"
    out = {}
    for base, combining, marks in ((voiced, "゙", "ﾞ゙゛"), (half_voiced, "゚", "ﾟ゚゜")):
        for hiragana in base:
            katakana = chr(ord(hiragana) + 0x60)
            for kana in (hiragana, katakana):
                whole = unicodedata.normalize("NFC", kana + combining)
                out |= {kana + mark: whole for mark in marks}
            out[_HALF_WIDTH[katakana] + marks[0]] = unicodedata.normalize("NFC", katakana + combining)
    return out


_HALF_WIDTH = {unicodedata.normalize("NFKC", chr(c)): chr(c) for c in range(0xFF66, 0xFF9E)}
