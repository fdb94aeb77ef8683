"""Training-data operations: decontamination, licences, tokenisation, URL rules,
language-model scores, near-duplicates, secrets, main text and language.

Nothing else in the library imports this subpackage.
"""
