"""Column functions: text, places, pay, dates, names and scores. Nothing here reads or writes."""
