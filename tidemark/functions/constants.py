"""Fixed values of notation, phonetics and singing that results depend on."""

from __future__ import annotations

# Symbols of the music font. Quarters of a head or rest (None: the whole bar), beams of a flag, semitones of an accidental, sign and
# diatonic number of the lowest line of a clef, factor of a tuplet digit.
NOTEHEADS = {"œ": 1.0, "˙": 2.0, "w": 4.0, "¿": 1.0, "Ï": 1.0}
X_HEADS = ("¿",)
RESTS = {"Œ": 1.0, "‰": 0.5, "≈": 0.25, "Ó": 2.0, "®": 0.125, "∑": None}
FLAGS = {"j": 1, "J": 1, "r": 2, "R": 2, "Â": 3, "Ê": 3}
ACCIDENTALS = {"#": 1, "b": -1, "n": 0, "Ü": 2, "º": -2}
CLEFS = {"&": ("G", 30), "?": ("F", 18), "B": ("C", 24)}
TUPLETS = {"3": 2 / 3, "5": 4 / 5, "6": 4 / 6, "7": 4 / 7, "2": 3 / 2, "4": 3 / 4}
OTHER_SYMBOLS = "0123456789.->,^_UuŸ<!'\""
STEP_SEMITONES = (0, 2, 4, 5, 7, 9, 11)
MUSIC_FONT, SPECIAL_FONT, TEXT_FONT, CHORD_FONT = "OpusStd", "OpusSpecialStd", "OpusTextStd", "OpusChordsStd"
DOT, OCTAVE_MARK = "™", "‹"
# Quarters of the note symbols that tempo marks use.
TEMPO_UNITS = {"q": 1.0, "h": 2.0, "e": 0.5}

# Ranks of voice names, by their first letters, the first that fits.
VOICE_RANKS = (("sopran", 6), ("mezzo", 5), ("alt", 4), ("tenor", 3), ("bariton", 2), ("bass", 1), ("s", 6), ("m", 5), ("a", 4), ("t", 3), ("bar", 2), ("b", 1))

# Sung syllables without a dictionary, in the phone alphabet SAMPA.
SCAT = {
    "la": "l A", "da": "d A", "dah": "d A", "ja": "j A", "ba": "b A", "na": "n A", "ta": "t A",
    "dam": "d A m", "bam": "b A m", "dum": "d U m", "bum": "b U m", "dm": "d I m", "dn": "d I n",
    "doo": "d u", "du": "d u", "dun": "d V n", "doon": "d u n", "dap": "d A p", "bap": "b A p",
    "ah": "A", "aah": "A", "oh": "@U", "ooh": "u", "oo": "u", "uh": "V", "mm": "m", "hm": "h m",
    "hmm": "h m", "m": "m", "n": "n", "hah": "h A", "ha": "h A", "ho": "h @U", "dee": "d i",
    "di": "d i", "ding": "d I N", "dong": "d A N", "dang": "d { N", "ding-dong": "d I N d A N",
    "shoo": "S u", "wah": "w A", "wa": "w A", "bop": "b A p", "ba-da": "b A d A", "pa": "p A",
    "dom": "d O m", "bom": "b O m", "bim": "b I m", "dim": "d I m", "tu": "t u", "tm": "t m",
    "o": "@U", "a": "A", "ahh": "A", "nah": "n A", "yeah": "j E", "oh-oh": "@U @U",
}
VOWELS = frozenset({"i", "I", "E", "{", "A", "V", "O", "U", "u", "@", "r=", "EI", "AI", "OI", "@U", "aU"})
SONORANTS = frozenset({"m", "n", "N", "l"})
# The phonetic alphabet to SAMPA; at a place the first entry that fits counts.
IPA = (
    ("eɪ", "EI"), ("aɪ", "AI"), ("ɔɪ", "OI"), ("oʊ", "@U"), ("əʊ", "@U"), ("aʊ", "aU"),
    ("tʃ", "tS"), ("dʒ", "dZ"), ("ɑːɹ", "A r"), ("ɔːɹ", "O r"), ("ɛɹ", "E r"), ("ɪɹ", "I r"),
    ("ʊɹ", "U r"), ("iə", "I @"), ("eə", "E @"), ("ʊə", "U @"),
    ("iː", "i"), ("uː", "u"), ("ɑː", "A"), ("ɔː", "O"), ("ɜː", "r="), ("ɚ", "r="), ("ɝ", "r="),
    ("i", "i"), ("ɪ", "I"), ("ᵻ", "I"), ("ɛ", "E"), ("e", "E"), ("æ", "{"), ("ɑ", "A"), ("a", "A"),
    ("ʌ", "V"), ("ɔ", "O"), ("ɒ", "A"), ("o", "@U"), ("ʊ", "U"), ("u", "u"), ("ə", "@"), ("ɐ", "@"),
    ("θ", "T"), ("ð", "D"), ("ʃ", "S"), ("ʒ", "Z"), ("ŋ", "N"), ("ɹ", "r"), ("r", "r"), ("ɾ", "4"),
    ("ɫ", "l"), ("l", "l"), ("x", "h"), ("ç", "h"),
    ("p", "p"), ("b", "b"), ("t", "t"), ("d", "d"), ("k", "k"), ("g", "g"), ("ɡ", "g"), ("f", "f"),
    ("v", "v"), ("s", "s"), ("z", "z"), ("h", "h"), ("m", "m"), ("n", "n"), ("w", "w"), ("j", "j"),
)
# SAMPA to the phones of the neural voices.
ARPABET = {
    "i": "iy", "I": "ih", "E": "eh", "{": "ae", "A": "aa", "V": "ah", "O": "ao", "U": "uh",
    "u": "uw", "@": "ax", "r=": "er", "EI": "ey", "AI": "ay", "OI": "oy", "@U": "ow", "aU": "aw",
    "p": "p", "b": "b", "t": "t", "d": "d", "k": "k", "g": "g", "4": "dx", "f": "f", "v": "v",
    "s": "s", "z": "z", "S": "sh", "Z": "zh", "T": "th", "D": "dh", "h": "hh", "m": "m", "n": "n",
    "N": "ng", "l": "l", "r": "r", "w": "w", "j": "y", "tS": "ch", "dZ": "jh",
}
# Seconds that a sung consonant of the neural voices may last (others: OTHER_CLIP), the silence before some of them, the token
# sung for some at a syllable's start, and the two parts of long closing diphthongs.
CLIPS = (
    (("b", "d", "g"), (0.03, 0.065)), (("dx",), (0.02, 0.05)), (("m", "n"), (0.06, 0.15)), (("ng",), (0.07, 0.2)), (("p", "t", "k"), (0.04, 0.13)),
    (("ch",), (0.08, 0.17)), (("jh",), (0.08, 0.15)), (("f", "th", "s", "sh", "hh"), (0.055, 0.18)), (("v", "z", "zh", "dh"), (0.05, 0.15)), (("l", "r", "w", "y"), (0.04, 0.13)),
)
OTHER_CLIP = (0.04, 0.15)
CLOSURES = ((("b", "d", "g"), 0.055), (("jh",), 0.035), (("p", "t", "k", "ch"), 0.02))
ONSET_TOKENS = {c: f"de/{c}" for c in ("b", "d", "g", "p", "t", "k")}
GLIDES = {"ay": ("aa", "y"), "ey": ("eh", "y"), "oy": ("ao", "y"), "aw": ("aa", "w"), "ow": ("ao", "w")}
HEAD, TAIL, SILENCE, BREATH = 0.12, 0.15, "SP", "AP"
# Singers of the voice kinds: bank, modes with weights, formant shift; and the banks that may stand in.
SINGERS = {
    "soprano": ("katyusha", (("delicate", 0.6), ("standard", 0.4)), 0.0),
    "alto": ("katyusha", (("lullaby", 0.7), ("standard", 0.3)), -0.25),
    "tenor": ("keiro_revenant", (("standard", 0.7), ("mellow", 0.3)), 0.0),
    "baritone": ("liam_thorne", (("standard", 0.6), ("gentle", 0.4)), 0.0),
    "bass": ("liam_thorne", (("deep", 0.8), ("standard", 0.2)), -0.15),
}
STAND_INS = {"soprano": ("katyusha",), "alto": ("katyusha",), **dict.fromkeys(("tenor", "baritone", "bass"), ("keiro_revenant", "liam_thorne"))}
# Milliseconds of a consonant of the diphone voices (others: 60), nasals, sounds without a pitch, and the vowels sung for others from
# a frequency on.
CONSONANT_MS = {
    "p": 60, "b": 50, "t": 55, "d": 45, "k": 65, "g": 50, "4": 25,
    "f": 80, "v": 60, "s": 90, "z": 70, "S": 90, "Z": 70, "T": 80, "D": 45, "h": 60,
    "tS": 100, "dZ": 90, "m": 60, "n": 60, "N": 60, "l": 55, "r": 55, "w": 55, "j": 50,
}
NASALS = frozenset({"m", "n", "N"})
UNVOICED = frozenset({"_", "p", "t", "k", "f", "s", "S", "T", "h", "tS"})
OPEN_VOWELS = {
    "i": ((500, "I"), (640, "E"), (800, "{")),
    "I": ((640, "E"), (800, "{")),
    "u": ((500, "U"), (800, "O")),
    "U": ((800, "O"),),
    "E": ((800, "{"),),
    "EI": ((800, "E"), (850, "{")),
    "@U": ((800, "O"),),
}
# Divisions of a quarter in MusicXML, and note types by their divisions.
DIVISIONS = 48
NOTE_TYPES = ((192, "whole"), (96, "half"), (48, "quarter"), (24, "eighth"), (12, "16th"), (6, "32nd"), (3, "64th"))
SAMPLE_RATE = 44_100


def note_shapes() -> dict[int, tuple[str, int, bool]]:
    """Divisions of every notatable duration: (type, dots, triplet). Types come from long to short, in each plain, dotted, double-dotted, triplet, and
    the first to claim a number of divisions has it."""
    out: dict[int, tuple[str, int, bool]] = {}
    for divisions, name in NOTE_TYPES:
        for num, den, dots, triplet in ((1, 1, 0, False), (3, 2, 1, False), (7, 4, 2, False), (2, 3, 0, True)):
            if divisions * num % den == 0:
                out.setdefault(divisions * num // den, (name, dots, triplet))
    return out
