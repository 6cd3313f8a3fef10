"""From template text to DataFrame plans: lexer, parser, checks, compiler, and reply text."""
