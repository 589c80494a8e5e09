"""Column -> Column functions: text, protected tokens, locale rewriting, glossary."""
