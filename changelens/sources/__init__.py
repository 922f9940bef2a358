"""Tables the engine reads: diffs, text files, generated answers."""
