"""Fixed values of the prompts: templates, guides and patterns. Models were asked in these very words."""

# The templates of the first prompt family; {language} is the corpus language.
BASIC = """Task: Predict dependency relations for {language} sentences.

Given a {language} sentence with tokens, predict the syntactic dependency relation for each token to its head.

Examples:
{examples}

Now predict the dependency relations for this sentence:

{language}: {target_text}
English: {target_text_en}

Tokens:
{target_tokens}

Output format: For each token, provide: TOKEN_ID FORM -> HEAD_ID RELATION

Answer:"""

DETAILED = """Task: Analyze {language} syntax and predict dependency relations.

You are analyzing {language}, a West African language. Each token has linguistic annotations including part-of-speech tags and English glosses to help with understanding.

Universal Dependencies Relations Guide:
- subj: subject of a verb
- comp:obj: object complement  
- det: determiner
- mod: modifier (adjective, adverb, etc.)
- conj: conjunction
- punct: punctuation
- flat: flat multiword expression (names)
- cc: coordinating conjunction

Examples:
{examples}

Analysis Task:
{language} sentence: {target_text}
English translation: {target_text_en}

Tokens with linguistic information:
{target_tokens_detailed}

For each token, analyze:
1. Its grammatical role in the sentence
2. Which word it depends on (head)  
3. The type of dependency relation

Provide your predictions in this format:
TOKEN_ID FORM [POS] -> HEAD_ID RELATION (reasoning)

Answer:"""

CHAIN_OF_THOUGHT = """Task: Step-by-step dependency relation prediction for {language}.

Let's analyze {language} dependency relations step by step, using the English glosses and translation to understand the meaning.

Examples with reasoning:
{examples_with_reasoning}

Now let's analyze this sentence step by step:

{language}: {target_text}
English: {target_text_en}

Step 1: Identify the main verb and root of the sentence
Step 2: Find the subject and object relationships  
Step 3: Identify modifiers, determiners, and other relations
Step 4: Handle coordination and subordination
Step 5: Assign final dependency relations

Tokens:
{target_tokens_detailed}

Let me work through this step by step:

Step 1 - Main verb identification:
[Think about which word is the main predicate]

Step 2 - Core arguments:
[Identify subject, object relationships]

Step 3 - Modifiers and determiners:
[Find words that modify or determine others]

Step 4 - Complex relations:
[Handle coordination, subordination, etc.]

Step 5 - Final predictions:
[Format: TOKEN_ID FORM -> HEAD_ID RELATION]"""

MULTILINGUAL = """Task: Cross-lingual dependency parsing for {language} using English alignment.

You will analyze {language} syntax by leveraging both the {language} text and its English translation. Use the word-level glosses to understand correspondences between languages.

Key principles:
- {language} may have different syntactic patterns than English
- Use glosses to understand semantic roles
- Consider that {language} may have different word order patterns
- Some relations may not have direct English equivalents

Examples:
{examples_crosslingual}

Target Analysis:

{language} text: {target_text}
English text: {target_text_en}

Word-by-word analysis:
{target_alignment}

Cross-lingual insights:
- Compare {language} and English syntactic patterns
- Use English structure as a guide but respect {language} grammar
- Pay attention to word order differences
- Consider morphological differences

Dependency predictions:
[For each {language} token, predict head and relation based on both languages]

TOKEN_ID {LANGUAGE}_FORM (Gloss: ENGLISH_GLOSS) -> HEAD_ID RELATION

Answer:"""

GLOSS_FOCUSED = """Task: Use English glosses to guide {language} dependency relation prediction.

The English glosses provide word-level translations that help understand the semantic role of each {language} word. Use these glosses to infer syntactic relationships.

Gloss interpretation guide:
- Articles (the, a) usually indicate determiners (det)
- Prepositions (in, on, of) often show oblique relations (comp:obj, udep)
- Conjunctions (and, or) indicate coordination (cc, conj)
- Pronouns often serve as subjects or objects (subj, comp:obj)

Examples:
{examples_gloss_focused}

Target sentence analysis:

{language}: {target_text}
English: {target_text_en}

Gloss-guided token analysis:
{target_gloss_analysis}

Using the glosses, predict dependency relations:

Instructions:
1. Read each gloss to understand the word's meaning
2. Determine how that meaning relates to other words
3. Assign the appropriate syntactic relation
4. Consider {language}-specific patterns from the examples

Predictions:
TOKEN_ID FORM (gloss) -> HEAD_ID RELATION

Answer:"""

FEW_SHOT_ADAPTIVE = """Task: Learn {language} dependency patterns from examples and apply to new sentence.

You are learning to parse {language} dependency relations. Study the patterns in the examples carefully, noting:
- Common dependency relations in {language}
- Typical word order patterns  
- How different parts of speech relate to each other
- Role of glosses in understanding meaning

Learning examples:
{adaptive_examples}

Pattern observations from examples:
[Based on the examples above, note key patterns you observe]

Target sentence to parse:
{language}: {target_text}
English: {target_text_en}

Tokens: {target_tokens}

Apply the patterns you learned:
TOKEN_ID FORM -> HEAD_ID RELATION

Answer:"""

# What the relations mean, in the second prompt family.
RELATIONS = {
    "subj": "subject of a verb",
    "comp:obj": "direct object of a verb",
    "comp:obl": "oblique complement (indirect object, prepositional complement)",
    "mod": "modifier (adjective, relative clause, noun modifier)",
    "det": "determiner",
    "conj": "conjunct in coordination",
    "conj:appos": "apposition",
    "cc": "coordinating conjunction",
    "flat": "flat structure (proper names, compounds)",
    "udep": "underspecified dependency",
    "punct": "punctuation",
    "root": "root of the sentence",
}

# Why a tag hangs on a tag by a relation.
PATTERNS = {
    ("PRON", "VERB", "subj"): "pronoun before verb typically indicates subject",
    ("NOUN", "VERB", "comp:obj"): "noun after verb typically indicates direct object",
    ("NOUN", "VERB", "subj"): "noun before verb can indicate subject",
    ("DET", "NOUN", "det"): "determiner always modifies noun",
    ("NOUN", "NOUN", "mod"): "noun can modify another noun",
    ("PROPN", "PROPN", "flat"): "proper nouns form flat structures in names",
    ("ADP", "VERB", "udep"): "preposition often depends on verb",
    ("NOUN", "ADP", "comp:obj"): "noun is object of preposition",
    ("CCONJ", "VERB", "cc"): "coordinating conjunction connects clauses",
}

# The order of relations in a worked example.
STEPS = ["subj", "comp:obj", "comp:obl", "mod", "det", "conj", "cc", "flat", "punct"]

# Openings and closings of the second prompt family.
C_BASIC_HEAD = """You are an expert in {language} syntax. Predict dependency relations between words.

Dependency Relations Guide:
"""
C_BASIC_TAIL = """

Output format:
Dependencies:
- [dependent] → [head] (relation)
- [dependent] → [head] (relation)
...

Your answer:"""
C_STEPS_HEAD = """Task: {language} Dependency Parsing
Analyze the sentence step by step to find syntactic dependencies.

Analysis Steps:
1. Identify the main verb (root of the sentence)
2. Find subjects of verbs
3. Find objects and complements of verbs
4. Identify modifiers and determiners
5. Handle coordination and punctuation

Example Analysis:

"""
C_CONTEXT_HEAD = """{language} Dependency Parsing with Linguistic Context

{language} Language Properties:
- Basic word order: Subject-Verb-Object (SVO)
- Determiners typically follow nouns (noun + determiner)
- Relative clauses use pronouns like "ki/ku/li"
- Prepositions precede their objects
- Proper names form flat structures
- Agglutinative morphology with various affixes

Common Syntactic Patterns:
"""
C_INTERACTIVE_HEAD = """I'll help you analyze this {language} sentence for dependencies step by step.

Let me show you how with an example:

"""
C_INTERACTIVE_TAIL = """

Question 1: What is the main verb (root) in this sentence?
Question 2: What words are subjects of verbs?
Question 3: What words are objects or complements?
Question 4: What modifiers and determiners do you see?
Question 5: Any coordination or punctuation?

Please provide your analysis:"""

# Fixed value: the instruction of the table format.
TABLE_SYSTEM = """You are a syntactic parser and formatter.
Given a sentence (and optional English translation), output a Universal Dependencies-style analysis.

Output STRICTLY as:
1) Three header lines:
   # sent_id = <ID>
   # text = <original sentence>
   # text_en = <English translation or leave the original if not given>
2) Then a token table with EXACTLY 10 TAB-separated columns per row:
   ID  FORM  LEMMA  UPOS  FEATS  HEAD  DEPREL  DEPS  MISC  Gloss=<english gloss>

Rules:
- IDs are 1..N with no gaps. Use 0 only as HEAD for the root token.
- If unknown, write underscore `_`.
- UPOS must be universal POS (NOUN, VERB, ADJ, ADV, PRON, DET, ADP, AUX, PROPN, NUM, PART, SCONJ, CCONJ, INTJ, PUNCT, SYM, X).
- DEPREL should be UD-like (root, nsubj/subj, obj/comp:obj, obl/comp:obl, amod/mod, case/udep, cc, conj, advmod, aux, cop, punct, etc.).
- Keep punctuation as separate tokens with UPOS=PUNCT.
- Put any flags (e.g., NoSpaceAfter=Yes) in MISC; place the English gloss in the final column as `Gloss=...`.
- Do NOT include explanations or code fences. Only output the formatted block.
"""
