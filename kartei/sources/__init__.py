"""Sources: the file walk, rule files, settings and error reports."""
