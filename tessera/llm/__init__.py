"""Training-data operators: filters, de-duplication, scoring and mixing over text tables.

Nothing else in the library imports this subpackage. An operator adds the columns that its `out` or
`prefix` names (op2 the list ADDED), in place of any of the same name; `runtime.unused` finds a name that is free.
Helper columns take free names. Tests run every operator on rows with clashing names.
"""
