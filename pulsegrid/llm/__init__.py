"""Operators for preparing language-model training data at scale.

Each module holds one operator with its own interface; ``queries`` applies them to the driver's
tables.  Every operator reads only the columns that its parameters name, so extra columns with any
names do no harm, and every operator takes empty tables.
"""
