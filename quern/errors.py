"""What can go wrong, by when it shows: at definition, at the call, or at the commit."""


#: What a DefinitionError's code can be.
CODES = frozenset(
    """
    aggregate-of-no-number batch-with-token column-not-settable composite-parent-key composite-related-key constant-filter-type
    deleted-in-key-pages deletion-mark-type eager-bypass eager-context-filter generated-composite-key generated-key-type
    json-path-on-no-text json-path-syntax list-of-composite-keys no-aggregate no-audit-role no-column
    no-criterion no-entity no-fields no-filter-of-that-name no-key no-key-to-find-by
    no-relation no-row-locks no-type nothing-to-restore order-not-shown order-on-predicate
    order-syntax page-without-order pattern-on-no-text projection-of-another role-twice same-column-name
    search-in-no-text total-of-distinct upsert-past-filter upsert-with-token view-is-read-only
    """.split()
)


class QuernError(Exception):
    pass


class DefinitionError(QuernError):
    """A store or entity is declared wrongly; raised when its class is defined, before any data is touched."""

    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code = code


class FilterValueMissing(QuernError):
    """A row filter needs a value that no enclosing scope gives; raised before anything runs."""


class ConcurrencyConflict(QuernError):
    """A row's token has changed, or the row is gone."""


class StoreError(QuernError):
    """A call that cannot be carried out: bad arguments, several rows where one was asked for, a key that is there."""
