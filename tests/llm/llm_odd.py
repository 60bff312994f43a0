"""Texts that operators must bear: null, empty, blanks, marks, non-ASCII, long words, a very long text."""

ODD = [None, "", " \n\t ", "...", "é ñ 漢字 🙂", "x" * 5000, "word " * 40000, "a\n" * 3000, "ΑΣ, ΣΑΣ. İ ẛ̣", "one two three"]
