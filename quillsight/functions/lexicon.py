"""Word lists, phrase tables and weights. All of them are parameters of the operators; these are the defaults."""

from __future__ import annotations

# Phrases by category, each after its weight, in order.

SELF_REFERENCE = """
1.0 as an ai
1.0 as a language model
1.0 as an artificial intelligence
1.0 i'm an ai
1.0 i am an ai
1.0 as a large language model
1.0 i'm just an ai
1.0 i'm a language model
1.0 as your ai assistant
0.95 i don't have personal experiences
0.9 i don't have feelings
0.9 i don't have opinions
0.9 i cannot have personal
0.95 i don't have consciousness
0.85 i was trained by
0.85 my training data
0.9 my knowledge cutoff
0.85 based on my training
"""

INABILITY = """
0.8 i cannot provide
0.7 i'm unable to
0.7 i am unable to
0.7 i can't actually
0.7 i cannot actually
0.7 i'm not able to
0.7 i don't have access to
0.7 i cannot access
0.8 i cannot browse
0.75 i cannot search
0.6 i cannot verify
0.6 i cannot confirm
"""

ASSISTANT_STYLE_A = """
0.7 i'd be happy to
0.7 i'd be glad to
0.7 i should note
0.65 i should mention
0.5 i appreciate you
0.5 i appreciate your
0.4 that said,
0.4 with that said
0.45 that being said
0.4 i want to be
0.5 i aim to
"""

ASSISTANT_STYLE_B = """
0.6 certainly!
0.5 absolutely!
0.7 great question!
0.7 excellent question
0.7 that's a great question
0.6 happy to help
0.6 glad you asked
0.5 sure thing!
0.4 of course!
"""

HEDGING = """
0.8 it's important to note
0.7 it is important to
0.7 it's worth noting
0.7 it is worth noting
0.7 it should be noted
0.7 it bears mentioning
0.6 keep in mind that
0.6 bear in mind that
0.5 please note that
0.5 do note that
0.6 it's crucial to
0.6 it is crucial to
0.6 it's essential to
0.6 it is essential to
0.55 it's vital to
0.5 importantly,
0.5 crucially,
0.45 notably,
0.4 significantly,
0.45 interestingly,
"""

TRANSITION = """
0.4 furthermore
0.4 moreover
0.4 additionally
0.4 in addition to this
0.5 in conclusion
0.5 to summarize
0.5 in summary
0.5 to conclude
0.45 to sum up
0.35 all in all
0.35 on the whole
0.35 by and large
0.4 in essence
0.35 essentially,
0.4 fundamentally,
0.35 ultimately,
0.3 overall,
0.35 consequently,
0.35 accordingly,
0.3 thus,
0.35 hence,
0.3 therefore,
0.4 as such,
0.45 that being said,
0.45 having said that,
0.45 with that in mind,
"""

CLOSING = """
0.7 i hope this helps
0.6 hope this helps
0.7 i hope that helps
0.6 hope that helps
0.7 i hope this was helpful
0.5 feel free to
0.5 don't hesitate to
0.5 please don't hesitate
0.4 let me know if
0.45 let me know if you
0.5 if you have any questions
0.55 if you have any further
0.55 if you need any clarification
0.5 if there's anything else
0.5 is there anything else
0.55 happy to clarify
0.55 happy to elaborate
0.5 happy to explain
"""

FORMAL = """
0.35 utilize
0.35 utilization
0.35 facilitate
0.35 facilitation
0.35 leverage
0.35 leveraging
0.6 delve into
0.55 delve deeper
0.55 delving into
0.4 dive into
0.4 dive deeper
0.3 explore the
0.5 unpack this
0.5 unpacking the
0.4 navigate the
0.4 navigating the
0.45 embark on
0.45 embarking on
0.5 endeavor to
0.5 endeavour to
0.45 commence with
0.3 prior to
0.4 subsequent to
0.4 in lieu of
0.25 in order to
0.4 pertaining to
0.35 with regard to
0.35 with regards to
0.35 in regard to
0.45 vis-à-vis
0.5 myriad of
0.45 a myriad
0.5 plethora of
0.45 multifaceted
0.35 nuanced
0.4 holistic
0.45 synergy
0.45 synergies
0.4 paradigm
0.45 paradigm shift
0.35 cutting-edge
0.35 state-of-the-art
"""

LIST_INTRODUCTION = """
0.5 here are some
0.5 here's a list
0.4 the following
0.5 here are a few
0.5 here are the key
0.5 here are the main
0.5 let me outline
0.5 let me break down
0.4 let me explain
0.45 allow me to
0.45 i'll outline
0.45 i will outline
0.45 i'll break down
0.5 consider the following
0.35 there are several
0.35 there are a few
0.35 there are multiple
"""

ACKNOWLEDGEMENT = """
0.6 you raise a good point
0.6 you make a good point
0.55 that's a valid point
0.55 that's a fair point
0.55 you're absolutely right
0.55 you are absolutely right
0.4 you're correct
0.4 you are correct
0.4 i understand your
0.4 i see what you
"""

DISCLAIMER = """
0.7 i would recommend consulting
0.6 consult with a professional
0.6 seek professional advice
0.55 consult a doctor
0.55 consult a lawyer
0.8 this is not professional advice
0.8 this is not legal advice
0.8 this is not medical advice
0.8 this is not financial advice
0.5 please consult
0.6 i recommend speaking with
0.5 for safety reasons
0.45 for your safety
"""

FILLER = """
0.4 in today's world
0.45 in this day and age
0.4 in the modern era
0.45 it goes without saying
0.4 needless to say
0.45 it is widely known
0.4 as we all know
0.4 as you may know
0.4 as you might expect
0.45 as one might expect
0.5 it is worth mentioning
0.45 this brings us to
0.45 this leads us to
0.4 let's take a look
0.4 let us consider
0.35 when it comes to
"""

EMPHASIS = """
0.4 it's really important
0.4 this is really important
0.35 particularly important
0.35 especially important
0.4 extremely important
0.45 absolutely essential
0.45 critically important
0.5 cannot be overstated
0.5 can't be overstated
"""

BALANCE = """
0.4 on the one hand
0.35 on the other hand
0.45 while it's true that
0.45 while this is true
0.4 although this may be
0.4 despite the fact that
0.45 notwithstanding
0.35 nonetheless
0.35 nevertheless
0.5 be that as it may
"""

CATEGORIES = {
    "self-reference": SELF_REFERENCE,
    "inability": INABILITY,
    "assistant-style A": ASSISTANT_STYLE_A,
    "assistant-style B": ASSISTANT_STYLE_B,
    "hedging": HEDGING,
    "transitions": TRANSITION,
    "closings": CLOSING,
    "formal vocabulary": FORMAL,
    "list introductions": LIST_INTRODUCTION,
    "acknowledgement": ACKNOWLEDGEMENT,
    "disclaimer": DISCLAIMER,
    "filler": FILLER,
    "emphasis": EMPHASIS,
    "balanced language": BALANCE,
}


def phrase_rows(categories: dict[str, str] = CATEGORIES) -> list[tuple[int, str, str, float]]:
    """(position, category, pattern, weight) in order."""
    lines = [(name, line) for name, block in categories.items() for line in block.strip().splitlines()]
    return [(i, name, line.split(" ", 1)[1], float(line.split(" ", 1)[0])) for i, (name, line) in enumerate(lines)]


PHRASES = phrase_rows()

# Contractions, looked for as substrings.
CONTRACTIONS = (
    "i'm i'll i've i'd you're you'll you've you'd he's she's it's we're they're "
    "don't doesn't didn't won't wouldn't can't couldn't shouldn't isn't aren't "
    "wasn't weren't haven't hasn't hadn't let's that's there's here's what's who's how's where's when's"
).split()

# Common words.
COMMON_WORDS = (
    "a an the "
    "i you he she it we they me him her us them my your his its our their this that "
    "in on at to for of with by from about into through during before after "
    "and or but so yet if when while because although "
    "is are was were be been being have has had do does did will would could should may might must can get got make made "
    "not no yes just only also very more most some any all many much other such than then now here there where what which who how why "
    "each every both few new old good bad first last long little own same big high small large next early young important public "
    "able man woman time year people way day thing world life hand part place case week work fact group number night point home water room "
    "mother area money story month lot right study book eye job word business issue side kind head house service friend "
    "father power hour game line end member law car city community name"
).split()

SIGNALS = (
    "sentence_variance",
    "vocabulary_richness",
    "burstiness",
    "punctuation_variety",
    "phrase_score",
    "word_length_variance",
    "contractions_usage",
    "repetition_score",
    "readability_variance",
    "ngram_uniformity",
)

# Signal weights of each preset, in the order of SIGNALS.
PRESETS = {
    "balanced": (0.10, 0.16, 0.07, 0.07, 0.20, 0.05, 0.09, 0.08, 0.09, 0.09),
    "strict": (0.08, 0.12, 0.05, 0.05, 0.30, 0.05, 0.12, 0.08, 0.08, 0.07),
    "lenient": (0.12, 0.18, 0.10, 0.08, 0.12, 0.08, 0.05, 0.10, 0.08, 0.09),
    "creative": (0.15, 0.20, 0.10, 0.10, 0.10, 0.08, 0.07, 0.05, 0.10, 0.05),
    "academic": (0.08, 0.20, 0.08, 0.05, 0.18, 0.06, 0.03, 0.12, 0.08, 0.12),
}

# Weights of detectors by modality; others weigh 1.
DETECTOR_WEIGHTS = {
    "text": {"local": 1.0, "hive": 1.2, "gptzero": 1.1, "openai": 0.9},
    "image": {"local": 1.0, "hive": 1.3},
    "audio": {"local": 1.0, "hive": 1.3},
    "video": {"local": 1.0, "hive": 1.4},
}


def preset_weights(preset: str = "balanced") -> tuple[float, ...]:
    """The weights of a preset; an unknown name gives the balanced ones."""
    return PRESETS.get(preset, PRESETS["balanced"])
