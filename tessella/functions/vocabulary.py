"""Word lists and patterns that results depend on."""

# Words about the task, not evidence.
DISCOURSE_WORDS = (
    "correct incorrect classification classify text sentence passage article statement indicates indicating indicated indicate describes describing described describe "
    "supports supporting supported support based basing context contextual prediction predict predicts evidence explanation explain important positive negative neutral "
    "entailment contradiction entail contradict premise hypothesis us u"
).split()
# Negation contractions, with and without apostrophe, and their stems.
NEGATION_CONTRACTIONS = (
    "n't nt cannot "
    "don't doesn't didn't isn't aren't wasn't weren't won't wouldn't can't couldn't shouldn't shan't mustn't needn't hasn't haven't hadn't ain't daren't mightn't "
    "dont doesnt didnt isnt arent wasnt werent wont wouldnt cant couldnt shouldnt shant mustnt neednt hasnt havent hadnt aint darent mightnt "
    "don doesn didn isn aren wasn weren won wouldn couldn shouldn shan mustn needn hasn haven hadn ain daren mightn"
).split()
# Words that carry polarity and are always kept.
POLARITY_WORDS = ["no", "not", "never", "nor", "neither", "none", "nobody", "nothing", "nowhere", "every", "some", "any", "all", *NEGATION_CONTRACTIONS]
# The normaliser's stopwords where no larger list is at hand.
NORMALISER_STOPWORDS = (
    "a an the and or but in on at to for of with by from up about into over after is are was were be been being have has had do does did will would can could shall "
    "should may might i you he she it we they me him her us them my your his its our their this that these those very just then than so too also now here there"
).split()
# The parser's own, different list.
PARSER_STOPWORDS = (
    "a an the and or but in on at to for of with by from up about into over after is are was were be been being have has had do does did will would can could shall "
    "should may might i you he she it we they me him her us them my your his its our their this that these those not no nor"
).split()
# Phrases by which a reply counts as refused.
REFUSAL_PHRASES = [
    "i cannot",
    "i can't",
    "i'm unable",
    "i am unable",
    "not able to",
    "i apologize",
    "i'm sorry",
    "i am sorry",
    "cannot fulfill",
    "cannot complete",
    "not appropriate",
    "i cannot provide",
    "i can't provide",
    "against policy",
    "not permitted",
]
# ASCII punctuation, and the marks stripped before erasure.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ERASURE_PUNCTUATION = ".,!?;:()[]{}'\""
# Clitics that are split off their word, and marks kept within words.
CLITICS = r"(?i)(?<=[A-Za-z])(n't|'re|'ve|'ll|'d|'m|'s)\b"
DETACHED = r"([^\w\s'‐‑‒–—―−-])"
