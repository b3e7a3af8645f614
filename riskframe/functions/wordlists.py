"""Word lists and small maps.

Fixed values: they must equal the published lists for results to agree.
"""

# English stop words of the NLTK stopwords corpus.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours
    yourself yourselves he him his himself she she's her hers herself it it's its
    itself they them their theirs themselves what which who whom this that that'll
    these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all
    any both each few more most other some such no nor not only own same so than too
    very s t can will just don don't should should've now d ll m o re ve y ain aren
    aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
    haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
    shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# Verbs whose negative contraction is written out.
CONTRACTED_VERBS = (
    "do", "ca", "would", "could", "should", "were", "had", "was", "did", "does",
    "have", "is", "has",
)

# Categorical codes of the loan table; "OTHER" is the default, "" stands for missing.
POLICY_CODES = {"PC1": 1, "PC2": 2, "PC3": 3, "PC4": 4, "PC5": 5, "OTHER": 6, "": 0}
VERIFICATION_CODES = {
    "VERIFIED - income source": 1, "VERIFIED - income": 1, "not verified": 2,
    "OTHER": 3, "": 0,
}
HOME_OWNERSHIP_CODES = {"NONE": 0, "OWN": 1, "MORTGAGE": 2, "RENT": 3, "OTHER": 4}

# Part-of-speech classes as groups of Penn Treebank tags.
TAG_CLASSES = {
    "noun": ("NN", "NNS", "NNP", "NNPS"),
    "pron": ("PRP", "PRP$", "WP", "WP$"),
    "verb": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"),
    "adj": ("JJ", "JJR", "JJS"),
    "adv": ("RB", "RBR", "RBS", "WRB"),
}

# Closed word classes: words whose tag does not depend on their form.
CLOSED_CLASS_TAGS = {
    "PRP": "i you he she it we they me him us them myself himself herself itself ourselves themselves",
    "PRP$": "my your his her its our their",
    "WP": "who whom what",
    "WP$": "whose",
    "WRB": "when where why how",
    "DT": "the a an this that these those each every some any no all both",
    "IN": "of in on at by for with from about into through during before after above below "
          "between against because if while since until although as than",
    "CC": "and or but nor",
    "TO": "to",
    "MD": "can could will would shall should may might must ca wo",
    "VB": "be have do go get make pay",
    "VBP": "am are",
    "VBZ": "is has does",
    "VBD": "was were had did went got made paid",
    "VBN": "been done gone",
    "RB": "not n't very too also just now then here there never always often again still soon",
    "JJ": "good bad new old high low able other same own",
    "JJR": "more less better worse",
    "JJS": "most least best worst",
}

# Word endings that decide the tag of an open-class word, first match first.
SUFFIX_TAGS = (
    ("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"),
    ("able", "JJ"), ("ible", "JJ"), ("ful", "JJ"), ("less", "JJ"), ("ous", "JJ"),
    ("ive", "JJ"), ("ic", "JJ"), ("al", "JJ"), ("est", "JJS"),
    ("ize", "VB"), ("ise", "VB"), ("ify", "VB"),
    ("ss", "NN"), ("us", "NN"), ("s", "NNS"),
)
