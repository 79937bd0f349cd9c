"""Word lists, phrases and sizes that decide how texts are cut. Results depend on every one of them."""

# fixed values: words that are never keywords
STOP_WORDS = (
    "the and for are was were this that with from have been will they their which about into more also when than those these each such some can all any but not its has had you your our use used using "
    "may must should would could both over after then there here only just even very well now new way get set let run see per via etc one two three four five first last next same other while where how what who"
).split()

# fixed values: openings that start a new topic
BREAKS = ["however", "nevertheless", "in contrast", "on the other hand", "meanwhile", "conversely", "that said", "in summary", "to summarize", "to conclude", "in conclusion", "to wrap up", "overall", "in closing"]

# fixed values: openings that go on with the text before, by reason; the first reason whose opening fits counts
SIGNALS = {
    "reference_continuity": ["this ", "it ", "they ", "these ", "that ", "those ", "its ", "their ", "such ", "the above", "the following", "the latter", "the former"],
    "elaboration": ["additionally", "furthermore", "moreover", "in addition", "what is more", "on top of that", "notably", "importantly", "it is worth", "it should be noted", "equally", "similarly", "likewise"],
    "example": ["for example", "for instance", "such as", "e.g.", "i.e.", "as an example", "to illustrate", "consider ", "as shown", "as seen", "as demonstrated", "take ", "imagine "],
    "cause_effect": ["because", "therefore", "thus", "hence", "as a result", "consequently", "this means", "this leads", "this causes", "this results", "this implies", "this suggests", "so "],
    "contrast_continuation": ["although", "even though", "despite", "whereas", "even if", "regardless", "notwithstanding", "while it", "while this"],
}

# fixed values: phrases of SIGNALS that plain text doesn't know
NOT_IN_TXT = ["it should be noted", "as seen"]

# fixed values: first words of shell commands
COMMANDS = ["source ", "python ", "python3 ", "cargo ", "npm ", "yarn ", "cd ", "git ", "export ", "pip ", "pip3 ", "brew ", "apt ", "sudo ", "bash ", "sh ", "make ", "./", "docker ", "kubectl "]

# fixed values: sizes, in bytes unless said otherwise
PROSE_MAX = 1200
PROSE_MIN = 350
SEMANTIC_MAX = 1500
SHORT_PARAGRAPH = 80
SECTION_MAX = 2000
WINDOW_MAX = 6000
SHEET_MAX = 2000

# fixed values: sizes in the structural mode of word-processor files
WORD_LONG = 500
WORD_SHORT = 80
WORD_PACK = 900
WORD_SECTION = 1200
WORD_TABLE = 6000

# fixed values: marks that end a sentence there, and what may follow them
WORD_ENDS = [".", "!", "?", "\u3002", "\uff01", "\uff1f", "\u061f", "\u05c3"]
WORD_CLOSERS = ['"', "'", ")", "]", "\u201d", "\u2019", " "]

# fixed values: keys of a JSON object that holds its records
ENVELOPES = ["features", "data", "results", "items", "records", "rows"]
