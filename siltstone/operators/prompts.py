"""What a model is asked for, stage by stage.  Each prompt names the keys that the stage's parser reads
(``functions.parse``, ``functions.text.holistic``) and shows the form of the reply."""

from __future__ import annotations

from ..functions.parse import KEYS

#: Kinds of knowledge a chunk may hold, and relations of causes to effects.
KINDS = ["idea", "framework", "principle", "example", "case_study", "tool", "warning", "action_step", "quote", "question", "personal_note"]
RELATIONS = ["causes", "enables", "prevents", "requires", "correlates"]

_SAME_LANGUAGE = "Write in the language of the text."

_ABOUT = {
    "type": f"one of {', '.join(KINDS)}",
    "title": "a short heading, may stay empty",
    "topic": "what it is mainly about, in three to eight words",
    "summary": "what it says, in two or three sentences",
    "key_points": "up to six points with commas between them",
    "source_quote": "a sentence worth quoting word for word, may stay empty",
    "my_takeaway": "the one lesson to keep",
    "confidence": "how sure you are, a number from 0 to 1",
    "applicability": "how it can be put to use, in one or two sentences",
}

CHUNK = (
    f"You read one part of a document and describe it. {_SAME_LANGUAGE}\nAnswer with these lines and nothing else, a key, a colon and the value, "
    "in this order. Put in real values, never words in angle brackets.\n" + "\n".join(f"{k}: ({_ABOUT[k]})" for k in KEYS)
)

HOLISTIC = (
    f"You read the summaries of all parts of one document. {_SAME_LANGUAGE}\nAnswer with two lines and nothing else:\n"
    "core_thesis: (what the whole document argues, in one or two sentences)\n"
    "domains: (the fields of knowledge it belongs to, with commas between them)"
)

CAUSAL = (
    f"You read the numbered summaries of a document's parts, in order, and list what leads to what. {_SAME_LANGUAGE} Take only what the text says "
    "or plainly implies, and name things as the text does.\nAnswer in this form and with nothing else; repeat the four lines for each link:\n"
    "causal_chains:\n- cause: (what comes first)\n  mechanism: (how it works, may stay empty)\n  effect: (what follows)\n"
    f"  relation: (one of {', '.join(RELATIONS)})\n\npreconditions:\n- (what must hold first, one a line)\n\n"
    "counterfactuals:\n- (what would not happen without something, one a line)"
)

CONTEXT = (
    "You get the summary of a document and one part of it. In one or two sentences say where the part stands in the document and what the document "
    "is about, for a reader who sees the part alone. Write in the part's language. Don't repeat the part, and add no heading or label."
)

CLEAN = (
    "You get a raw transcript. Give it back readable: leave out time marks, marks of sounds such as [Music], and stretches said twice; part words that "
    "run together; set missing punctuation; drop filler words where they break a sentence. Keep the wording, the language, the order and the paragraphs, "
    "and add nothing. Answer with the text alone."
)

IMAGE = "You get a picture. Describe what it shows, texts in it included, in a few plain sentences."

QUERY = "You get a question to a knowledge base. Answer with one search query and nothing else: the question with its key words and synonyms, in its language."

PROMPTS = {"chunk": CHUNK, "holistic": HOLISTIC, "causal": CAUSAL, "context": CONTEXT, "clean": CLEAN, "image": IMAGE, "query": QUERY}

#: Added to a stage's prompt when the reply before was of no use.
AGAIN_REPEATED = "Your last answer said the same words over and over. Write a new one without repetitions."
AGAIN_INVALID = "Your last answer did not have the form asked for: a value was missing or still in angle brackets, or a line had no key. Write it anew in exactly that form. It was:\n"


def variants(n: int) -> str:
    """The prompt for several search queries."""
    return f"You get a question to a knowledge base. Write {n} different search queries for it, other words and other sides of it, in its language. Answer with a numbered list from 1 on, one query a line."


def with_context(prompt: str, context: str) -> str:
    """A prompt with what the asker knows already; blank context adds nothing."""
    return f"{prompt}\n\nContext:\n{context}" if context.strip() else prompt
