"""Column functions: text, titles, urls, times, scores and anchors."""
