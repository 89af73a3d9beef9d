"""Plain restatements of the problems for tests."""

import re


def blocks(text):
    """Code points of each block, by going through the lines one after the other."""
    lines = re.sub(r"\r\n|\r", "\n", text).split("\n")
    out, run, fence = [], None, None
    for line in lines:
        m = re.match(r" *(```|~~~)", line)
        if fence:
            run.append(line)
            if m and m.group(1) == fence:
                out.append(run)
                run, fence = None, None
            continue
        if m:
            if run is not None:
                out.append(run)
            run, fence = [line], m.group(1)
        elif re.fullmatch("[ \t ]*", line) or re.match("#{1,6} ", line):
            if run is not None:
                out.append(run)
            run = None
        else:
            run = (run or []) + [line]
    if run is not None:
        if fence and lines[-1] == "" and len(run) > 1:
            run = run[:-1]  # after the last line end there is no line
        out.append(run)
    return [len("\n".join(r)) for r in out]
