"""Nothing streams here: every operator takes a DataFrame, and those without sorting or
driver-side fits also take a streaming one inside ``foreachBatch``."""
