"""From text to a bound algebra: lexer, parser, binder and plan printer. No Spark here."""
