"""The operators: DataFrames in, DataFrames out.

Each stands for a component of a text, report or knowledge function. ``fidelity`` in a docstring says whether it is
a real part of that function (partial) or shows its mechanics on stand-in data (stand-in).

Cases that all operators share: they read only the columns that they name, so further columns, whatever their names,
change nothing; an empty table gives an empty result, except where a docstring says otherwise; text of any length is read whole;
rows that are repeated count as often as they come. A docstring says what nulls and ties do.
"""
