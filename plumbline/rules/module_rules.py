"""Rules that one fact of a module decides: ``id: (relation, condition, confidence)``.

A condition is SQL over the fact's columns ``a, b, c, n, f``; all rules are evaluated in one pass over the facts.
"""

from __future__ import annotations

_AGG = "('sum','count','count_big','avg','min','max','stdev','stdevp','var','varp','grouping','grouping_id','string_agg','checksum_agg','approx_count_distinct')"
_DATE_FN = "('year','month','day','datepart','datediff','datediff_big','dateadd','datename')"
_LEFT_FN = "element_at(filter(f, x -> x like 'l:call:%'), 1)"
_FILTER = "(array_contains(f,'where') or array_contains(f,'on') or array_contains(f,'having') or array_contains(f,'merge_on'))"
_LCOL = "exists(f, x -> x like 'lcol:%') and not array_contains(f,'dead')"


def _has(*flags: str) -> str:
    return " and ".join(f"array_contains(f,'{x}')" for x in flags)


def _fn(names: str) -> str:
    return f"{_FILTER} and {_LCOL} and n > 1 and substring(coalesce(try_element_at(filter(f, x -> x like 'l:call:%'), 1), ''), 8) in {names}"


# Names that the rules list.
_LEGACY_VIEWS = "('sysaltfiles','syscacheobjects','syscharsets','syscolumns','syscomments','sysconfigures','sysconstraints','syscurconfigs','sysdatabases','sysdepends','sysdevices','sysfilegroups','sysfiles','sysforeignkeys','sysfulltextcatalogs','sysindexes','sysindexkeys','syslanguages','syslockinfo','syslogins','sysmembers','sysmessages','sysobjects','sysoledbusers','sysopentapes','sysperfinfo','syspermissions','sysprocesses','sysprotects','sysreferences','sysremotelogins','sysservers','systypes','sysusers')"
_LEGACY_PROCS = "('sp_addapprole','sp_addlogin','sp_addremotelogin','sp_addrole','sp_addrolemember','sp_addserver','sp_addsrvrolemember','sp_adduser','sp_approlepassword','sp_change_users_login','sp_changedbowner','sp_changeobjectowner','sp_dbfixedrolepermission','sp_defaultdb','sp_defaultlanguage','sp_denylogin','sp_dropalias','sp_dropapprole','sp_droplogin','sp_dropremotelogin','sp_droprole','sp_droprolemember','sp_dropsrvrolemember','sp_dropuser','sp_grantdbaccess','sp_grantlogin','sp_helpremotelogin','sp_helprotect','sp_helpuser','sp_password','sp_remoteoption','sp_revokedbaccess','sp_revokelogin','sp_srvrolepermission')"
_SERIAL = "('error_line','error_message','error_number','error_procedure','error_severity','error_state','ident_current','object_id')"
_NO_FRAME = "('row_number','rank','dense_rank','ntile','lag','lead','percent_rank','cume_dist','percentile_cont','percentile_disc')"
_NATIVE_DENIED = "('app_name','binary_checksum','charindex','checksum','col_name','collationproperty','compress','concat','current_timezone','datalength','db_id','db_name','decompress','file_id','format','formatmessage','has_perms_by_name','hashbytes','ident_current','indexproperty','isdate','isnumeric','lower','object_id','object_name','objectproperty','parsename','patindex','permissions','quotename','replace','reverse','schema_id','schema_name','soundex','stats_date','stdev','stdevp','string_split','stuff','type_name','upper','var','varp')"
_CRED = "rlike '(?i)(passw|pwd|secret|token|api_?key|credential)'"
_BENIGN_IP = "rlike '^.?(?:0\\\\.0\\\\.0\\\\.0|127\\\\.|255\\\\.255|169\\\\.254\\\\.169\\\\.254)'"
_IP = "rlike '(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\\\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9.])'"

FACT_RULES: dict[str, tuple[str, str, str]] = {
    # predicates that an index can't seek on
    "tier1/date-function-on-column": ("pred", _fn(_DATE_FN), "High"),
    "tier1/case-fold-on-column": ("pred", _fn("('upper','lower')"), "High"),
    "tier1/charindex-or-left-on-column": ("pred", _fn("('charindex','left')"), "High"),
    "tier1/cast-or-convert-on-column": ("pred", f"{_FILTER} and {_LCOL} and {_has('l:cast')}", "Medium"),
    "tier1/column-arithmetic": ("pred", f"{_FILTER} and {_LCOL} and {_has('l:arith')}", "High"),
    "tier1/leading-wildcard-like": ("pred", f"{_FILTER} and b = 'like' and {_LCOL} and {_has('leading_wildcard')}", "High"),
    "tier1/function-wrapped-column": (
        "pred",
        f"{_FILTER} and {_LCOL} and (({_has('l:case')}) or (exists(f, x -> x like 'l:call:%') and substring(try_element_at(filter(f, x -> x like 'l:call:%'), 1), 8) not in {_AGG} and substring(try_element_at(filter(f, x -> x like 'l:call:%'), 1), 8) not in {_DATE_FN} and substring(try_element_at(filter(f, x -> x like 'l:call:%'), 1), 8) not in ('upper','lower','charindex','left','json_value')))",
        "High",
    ),
    "tier1/regexp-pattern-no-literal-prefix": ("call", "a = 'regexp_like' and n >= 2 and element_at(split(b, ' , '), 2) like \"'%\" and not element_at(split(b, ' , '), 2) rlike \"^'\\\\^[A-Za-z0-9 _-]\"", "High"),
    "correctness/between-end-of-period-boundary": ("pred", "b = 'between' and c rlike \"23:59:59(\\\\.\\\\d{0,6})?'$\"", "Medium"),
    "predicates/catch-all-parameter": ("pred", _has("catch_all"), "High"),
    "deprecated-syntax/equals-null-comparison": ("pred", f"b = '=' and (({_has('r:null')}) or ({_has('l:null')}))", "High"),
    "deprecated-syntax/not-equals-null-comparison": ("pred", f"b in ('<>','!=') and (({_has('r:null')}) or ({_has('l:null')}))", "High"),
    "deprecated-syntax/like-with-no-wildcard": ("pred", f"b = 'like' and {_has('no_wildcard')}", "High"),
    "duplication/always-true-or-false-literal-comparison": ("pred", _has("literals"), "High"),
    "duplication/mutually-exclusive-and-condition": ("pred", _has("contradiction"), "High"),
    "duplication/redundant-and-condition": ("pred", _has("idle_bound"), "High"),
    "duplication/identical-binary-operands": ("pred|op", _has("identical_operands"), "High"),
    # comments, lines, size
    "deprecated-syntax/task-comment-todo": ("comment", "a rlike '\\\\bTODO\\\\b'", "High"),
    "deprecated-syntax/task-comment-fixme": ("comment", "a rlike '\\\\bFIXME\\\\b'", "High"),
    "duplication/commented-out-code": (
        "comment",
        "trim(regexp_replace(a, '^(--+|/\\\\*+)|\\\\*/$', '')) rlike '(?is)^(select\\\\s.+\\\\sfrom\\\\s+[\\\\w.\\\\[\\\\]]+|insert\\\\s+into\\\\s+[\\\\w.\\\\[\\\\]]+\\\\s*(\\\\(|select|values)|update\\\\s+[\\\\w.\\\\[\\\\]]+\\\\s+set\\\\s+[\\\\w.\\\\[\\\\]]+\\\\s*=|delete\\\\s+from\\\\s+[\\\\w.\\\\[\\\\]]+(\\\\s+where\\\\s.+)?;?$|exec(ute)?\\\\s+[\\\\w.\\\\[\\\\]]+(\\\\s+@\\\\w+.*)?;?$|set\\\\s+@\\\\w+\\\\s*=|declare\\\\s+@\\\\w+\\\\s+\\\\w+)'",
        "Medium",
    ),
    "metrics/line-too-long": ("line", "a = 'long'", "High"),
    "metrics/module-too-long": ("size", "n > 1000", "High"),
    "metrics/routine-too-long": ("size", "n > 400", "Medium"),
    "metrics/too-many-parameters": ("module", "n > 15", "High"),
    "metrics/nesting-too-deep": ("stmt", _has("deep"), "High"),
    "metrics/too-many-conditional-operators": ("cond", "n > 4", "High"),
    "metrics/too-many-case-branches": ("case", "n > 5", "High"),
    "metrics/case-branch-too-long": ("op", _has("long_branch"), "High"),
    "formatting/tab-character": ("line", "a = 'tab'", "High"),
    "formatting/multiple-statements-per-line": ("mark", _has("same_line"), "High"),
    "formatting/multiple-declarations-per-line": ("var", _has("same_line"), "High"),
    "formatting/missing-begin-end": ("stmt", f"a in ('if','while') and {_has('unbraced')}", "High"),
    "formatting/single-line-conditional-body": ("stmt", f"a in ('if','while') and {_has('unbraced', 'same_line_body')}", "High"),
    "formatting/dangling-statement-after-unbraced-body": ("stmt", _has("dangling"), "High"),
    "formatting/redundant-parentheses": ("op", _has("redundant_parens"), "Medium"),
    "formatting/missing-file-header-comment": ("size", "not array_contains(f,'header_comment')", "High"),
    # names
    "naming/reserved-keyword-as-identifier": ("module", _has("quoted_reserved"), "High"),
    "naming/sp-prefix-on-user-routine": ("module", "a in ('procedure','function') and element_at(split(b, '\\\\.'), -1) like 'sp\\\\_%'", "High"),
    "naming/unqualified-create": ("module", _has("unqualified"), "High"),
    # old syntax
    "deprecated-syntax/non-ansi-comparison-operator": ("op", "a in ('!=','!<','!>')", "High"),
    "deprecated-syntax/legacy-system-compatibility-view": ("from_ref", f"c = 'table' and element_at(split(a, '\\\\.'), -1) in {_LEGACY_VIEWS} and not a like '%sys.sys%'", "High"),
    "deprecated-syntax/table-hint-without-with": ("hint", _has("no_with"), "High"),
    "deprecated-syntax/numbered-procedure-definition": ("module", _has("numbered"), "High"),
    "deprecated-syntax/numbered-procedure-execution": ("exec", _has("numbered"), "High"),
    "deprecated-syntax/string-literal-column-alias": ("select_item", "b = 'string'", "High"),
    "deprecated-syntax/removed-security-stored-procedure": ("exec", f"element_at(split(a, '\\\\.'), -1) in {_LEGACY_PROCS}", "High"),
    "deprecated-syntax/deprecated-set-rowcount": ("set_opt", "a = 'rowcount'", "High"),
    "deprecated-syntax/legacy-lob-statement": ("stmt", "a in ('readtext','writetext','updatetext')", "High"),
    "deprecated-syntax/legacy-lob-function": ("call", "a in ('textptr','textvalid')", "High"),
    "deprecated-syntax/legacy-lob-local-variable": ("var", "b in ('text','ntext','image')", "High"),
    # statements
    "statement-shape/insert-without-column-list": ("stmt", "a = 'insert' and b <> '' and not array_contains(f,'column_list')", "High"),
    "statement-shape/ordinal-order-by": ("order_item", _has("ordinal"), "High"),
    "statement-shape/bare-select-star": ("select_item", "c = 'star' and not array_contains(f,'subquery')", "High"),
    "query/unbounded-table-write": ("stmt", "a in ('update','delete') and not array_contains(f,'where') and not array_contains(f,'top')", "High"),
    "query/bare-top-no-order-by": ("query", f"{_has('top')} and not array_contains(f,'order') and not array_contains(f,'top_100_percent')", "High"),
    "query/unqualified-table-reference": ("from_ref", "c = 'table' and n = 1 and a not in ('inserted','deleted')", "Medium"),
    "query/linked-server-or-cross-database-reference": ("from_ref", "c = 'table' and n >= 3", "Medium"),
    "query/merge-missing-holdlock": ("stmt", "a = 'merge' and not array_contains(f,'holdlock')", "High"),
    "query/merge-unconditional-delete": ("stmt", "a = 'merge action' and b = 'delete' and not array_contains(f,'conditional')", "High"),
    "query/global-cursor-declaration": ("cursor", "not array_contains(f,'local')", "High"),
    "query/grouping-sets-cardinality-limit-exceeded": ("group_item", "(b = 'sets' and n > 4096) or (b = 'width' and a = 'cube' and n > 12) or (b = 'width' and a = 'rollup' and n > 32)", "High"),
    "query/recursive-cte-missing-maxrecursion": ("cte", _has("recursive"), "Medium"),
    "lineage/multi-referenced-cte": ("cte", "n >= 2 and not array_contains(f,'recursive')", "High"),
    "view/top-percent-order-by-no-op": ("query", f"{_has('top_100_percent', 'order')}", "High"),
    "tvf-fence/insert-exec": ("stmt", "a = 'insert' and c in ('exec','execute')", "High"),
    # windows and functions
    "window-frame/explicit-range": ("window", "b = 'range'", "High"),
    "window-frame/implicit-default-range": ("window", f"b = '' and {_has('ordered')} and a not in {_NO_FRAME}", "High"),
    "window-function/lag-lead-negative-offset": ("call", "a in ('lag','lead') and n >= 2 and element_at(split(b, ' , '), 2) rlike '^- ?\\\\d+$'", "High"),
    "window-function/percentile-out-of-range": ("call", "a in ('percentile_cont','percentile_disc') and try_cast(c as double) is not null and (try_cast(c as double) > 1 or try_cast(c as double) < 0)", "High"),
    "window-function/tablesample-percent-out-of-range": ("hint", f"{_has('sample')} and (n < 0 or n > 100)", "High"),
    "string-tvf/string-split-separator-length": ("call", "a = 'string_split' and n >= 2 and element_at(split(b, ' , '), 2) rlike \"^n?'\" and length(element_at(split(b, ' , '), 2)) - 2 - cast(element_at(split(b, ' , '), 2) like 'n%' as int) <> 1", "High"),
    "string-tvf/string-split-enable-ordinal-not-constant": ("call", "a = 'string_split' and n = 3 and (array_contains(f,'arg2:var') or array_contains(f,'arg2:column'))", "High"),
    "string-tvf/string-split-enable-ordinal-value": ("call", "a = 'string_split' and n = 3 and try_cast(element_at(split(b, ' , '), 3) as int) not in (0, 1)", "High"),
    "string-tvf/string-split-enable-ordinal-type": ("call", "a = 'string_split' and n = 3 and array_contains(f,'arg2:literal') and try_cast(element_at(split(b, ' , '), 3) as int) is null", "High"),
    "string-builtin/space-truncated": ("call", "a = 'space' and try_cast(c as bigint) > 8000", "High"),
    "string-builtin/replicate-truncated": ("call", "a = 'replicate' and n = 2 and c rlike \"^'\" and try_cast(element_at(split(b, ' , '), 2) as bigint) * greatest(1, length(c) - 2) > 8000", "High"),
    "forced-serial/nonparallelizable-intrinsic": ("call", f"a in {_SERIAL} and (array_contains(f,'select') or {_FILTER})", "High"),
    "forced-serial/fast-forward-cursor": ("cursor", f"({_has('fast_forward')}) or ({_has('forward_only', 'read_only')} and not exists(f, x -> x in ('static','keyset','dynamic')))", "High"),
    "forced-serial/table-variable-modification": ("stmt", f"a = 'dml' and {_has('table_variable')}", "High"),
    "control-flow/waitfor": ("stmt", "a = 'waitfor'", "High"),
    "control-flow/goto-usage": ("stmt", "a = 'goto'", "High"),
    "control-flow/empty-catch-block": ("stmt", "a = 'catch' and n = 0", "High"),
    "control-flow/dirty-read-isolation-hint": ("hint", "a in ('nolock','readuncommitted')", "High"),
    "control-flow/read-committed-lock-reverts-row-versioning": ("hint", "a = 'readcommittedlock'", "Low"),
    "control-flow/duplicated-call-argument": ("call", _has("same_args"), "Medium"),
    "control-flow/legacy-identity-intrinsic": ("global", "a = '@@identity'", "High"),
    "control-flow/case-expression-missing-else": ("case", f"{_has('simple')} and not array_contains(f,'else')", "High"),
    "control-flow/non-deterministic-case-input": ("case", f"{_has('simple')} and a rlike '\\\\b(newid|rand|crypt_gen_random) \\\\('", "High"),
    "control-flow/unresolved-transaction": ("stmt", _has("open_tran"), "Medium"),
    "control-flow/unassigned-output-parameter": ("param_use", f"{_has('output')} and not array_contains(f,'written')", "Medium"),
    # doubles
    "duplication/self-assignment": ("assign", _has("self"), "High"),
    "duplication/repeated-unary-operator": ("op", _has("repeated"), "High"),
    "duplication/negated-comparison-as-opposite": ("op", _has("negated"), "High"),
    "duplication/duplicate-sibling-condition": ("stmt|case", _has("same_conditions"), "High"),
    "duplication/identical-branch-bodies": ("case", _has("some_same"), "High"),
    "duplication/all-branches-identical": ("case|stmt", f"({_has('all_same')}) or ({_has('same_bodies')})", "High"),
    "duplication/collapsible-nested-if": ("stmt", _has("collapsible"), "High"),
    "duplication/nested-conditional-expression": ("op", _has("nested_iif"), "High"),
    "duplication/single-iteration-loop": ("stmt", _has("single_iteration"), "Medium"),
    # dead code
    "dead-code/unreachable-code": ("mark", _has("unreachable"), "High"),
    "dead-code/unused-local-variable": ("var_use", "n = 0", "High"),
    "dead-code/unused-parameter": ("param_use", "n = 0 and not array_contains(f,'output')", "High"),
    # dynamic SQL and security
    "dynamic-sql/analyzed": ("exec", _has("dynamic", "constant"), "High"),
    "dynamic-sql/unanalyzable": ("exec", _has("dynamic", "variable"), "High"),
    "dynamic-sql/exec-string-concatenates-parameterizable-value": ("exec", f"a = '(dynamic)' and {_has('concatenated')}", "Medium"),
    "security/unprovable-dynamic-sql-text": ("exec", _has("dynamic", "variable"), "Medium"),
    "security/hard-coded-credential": ("assign", f"array_contains(f,'var') and array_contains(f,'src:literal') and a {_CRED} and length(b) > 2", "High"),
    "security/hard-coded-ip-address": ("literal", f"c = 'string' and a {_IP} and not a {_BENIGN_IP}", "High"),
    "security/weak-hash-algorithm": ("call", "a = 'hashbytes' and lower(c) rlike \"^n?'(md2|md4|md5|sha|sha1)'$\"", "High"),
    "security/weak-hash-algorithm-sensitive-context": ("call", f"a = 'hashbytes' and lower(c) rlike \"^n?'(md2|md4|md5|sha|sha1)'$\" and b {_CRED}", "High"),
    "security/external-rest-endpoint-call": ("exec", "a like '%sp_invoke_external_rest_endpoint'", "High"),
    # session settings
    "session-date/set-dateformat": ("set_opt", "a like 'dateformat%'", "High"),
    "session-date/set-datefirst": ("set_opt", "a like 'datefirst%'", "High"),
    "session-date/ambiguous-date-literal-conversion": ("cast", "a rlike '^(date|datetime|datetime2|smalldatetime|datetimeoffset)' and c = '' and b rlike \"^'(0?[1-9]|1[0-2])[/.-](0?[1-9]|1[0-2])[/.-][0-9]{2,4}\"", "High"),
    "set-option/numeric-roundabort-on": ("set_opt", "a = 'numeric_roundabort' and b = 'on'", "Medium"),
    "set-option/ansi-warnings-off": ("set_opt", "a = 'ansi_warnings' and b = 'off'", "Medium"),
    "set-option/concat-null-yields-null-off": ("set_opt", "a = 'concat_null_yields_null' and b = 'off'", "Medium"),
    "set-option/ansi-padding-off": ("set_opt", "a = 'ansi_padding' and b = 'off'", "Medium"),
    # joins
    "join/cartesian-cross-join": ("from_ref", _has("cross join"), "Low"),
    # triggers
    "trigger/logon-trigger-host-name-gate": ("call", "a = 'host_name' and array_contains(f,'if')", "Medium"),
    # scopes of one statement
    "dead-code/redundant-jump": ("stmt", f"a = 'goto' and {_has('to_next')}", "High"),
    "formatting/if-following-prior-block-end": ("mark", _has("if_after_end"), "High"),
    "view/order-by-not-guaranteed": ("query", f"array_contains(f,'statement') and {_has('order', 'in_view')} and ((array_contains(f,'top') and not array_contains(f,'top_100_percent')) or array_contains(f,'offset'))", "Medium"),
    "control-flow/cursor-close-on-commit": ("stmt", "a in ('commit','rollback') and array_contains(f,'on:cursor_close_on_commit') and exists(f, x -> x like 'open:%')", "High"),
    "control-flow/commit-after-xact-abort-dooms-transaction": ("stmt", f"a = 'commit' and {_has('in_catch', 'on:xact_abort', 'before_try')}", "High"),
    "control-flow/unresolved-implicit-transaction": ("stmt", f"a = 'end' and {_has('implicit_tran')}", "Medium"),
    "predicates/openxml-with-clr-type-rejected": ("ddl", f"{_has('with_schema')} and a = 'openxml' and c rlike '^(geometry|geography|hierarchyid)'", "High"),
    "predicates/openrowset-with-legacy-type-rejected": ("ddl", f"{_has('with_schema')} and a = 'openrowset' and c rlike '^(sql_variant|text|ntext|image)\\\\b'", "High"),
    "predicates/openrowset-with-clr-type-rejected": ("ddl", f"{_has('with_schema')} and a = 'openrowset' and c rlike '^(geometry|geography|hierarchyid)'", "High"),
    "predicates/openrowset-with-xml-rejected": ("ddl", f"{_has('with_schema')} and a = 'openrowset' and c rlike '^xml'", "High"),
    "predicates/external-table-unsupported-column-type": ("ddl", f"{_has('column', 'external')} and c rlike '^(sql_variant|xml|hierarchyid|geometry|geography|text|ntext|image|timestamp|rowversion|json|vector)\\\\b'", "High"),
    "predicates/legacy-lob-conversion-target": ("cast", "a rlike '^(text|ntext)collate.*_(utf8|sc)(_|$)'", "High"),
    "predicates/xml-schema-collection-notation-type": ("ddl", f"{_has('xml_schema')} and c rlike '(type|base|itemType|memberTypes) *= *[\"\\\\x27]([^\"]* )?(\\\\w+:)?NOTATION[\"\\\\x27]'", "High"),
    "predicates/xml-schema-collection-id-idref-type": ("ddl", f"{_has('xml_schema')} and c rlike '(type|base|itemType|memberTypes) *= *[\"\\\\x27]([^\"]* )?(\\\\w+:)?(ID|IDREF|IDREFS)[\"\\\\x27]'", "High"),
    "naming/redundant-type-qualifier": ("var|param", "b rlike '^\\\\[?dbo\\\\]?\\\\.' or b rlike '^dbo\\\\.'", "Medium"),
    "forced-parameterization/dml-output-list-literal": ("literal", "b = 'output'", "Low"),
    "forced-parameterization/constant-foldable-expression-literal": ("pred", "b in ('=','<>','!=','<','<=','>','>=') and array_contains(f,'l:column') and array_contains(f,'r:arith') and c rlike '^[0-9.]+( [-+*/%] [0-9.]+)+$'", "Low"),
    "string-builtin/replace-truncated": ("call", "a = 'replace' and n = 3 and array_contains(f,'arg0:literal') and c rlike \"^n?'\" and length(c) - 2 - cast(c like 'n%' as int) > if(c like 'n%', 4000, 8000)", "High"),
    # statements that fail
    "graph/pseudo-column-assignment": ("assign", _has("pseudo"), "High"),
    "restore/option-conflict": ("stmt", "a = 'restore' and size(array_intersect(split(c, '[ ,()]+'), array('recovery','norecovery','standby'))) >= 2", "High"),
    "create-database/option-conflict": ("stmt", "a = 'create database' and c like '%containment = partial%' and c like '%catalog_collation%'", "High"),
    "query/partition-rebuild-number-exceeds-ceiling": ("stmt", "a in ('alter table','alter index') and try_cast(regexp_extract(c, 'rebuild partition = (\\\\d+)', 1) as bigint) > 15000", "High"),
    "predicates/for-xml-explicit-inline-xsd": ("query", f"{_has('for')} and a like '%explicit%' and a like '%xmlschema%'", "High"),
    "catalog/drop-fixed-database-role": ("stmt", "a = 'drop' and b = 'role' and c rlike '\\\\b(db_owner|db_accessadmin|db_securityadmin|db_ddladmin|db_backupoperator|db_datareader|db_datawriter|db_denydatareader|db_denydatawriter)\\\\b'", "High"),
    "catalog/memory-optimized-ledger-conflict": ("stmt", "a = 'create table' and c rlike 'memory_optimized = on' and c rlike 'ledger = on'", "High"),
    "predicates/full-text-predicate-in-aggregate": ("call", f"a in {_AGG} and b rlike '\\\\b(contains|freetext) \\\\(' and not array_contains(f,'windowed')", "Medium"),
}

#: Literals that stay literals although the database parameterizes statements, by the region they stand in.
LITERAL_REGIONS = {
    "forced-parameterization/top-or-paging-literal": ("top", "paging"),
    "forced-parameterization/select-list-literal": ("select",),
    "forced-parameterization/order-by-expression-literal": ("order",),
    "forced-parameterization/group-by-expression-literal": ("group",),
    "forced-parameterization/having-literal": ("having",),
    "forced-parameterization/table-sample-size-literal": ("tablesample",),
}
FACT_RULES |= {k: ("literal", "b in (" + ",".join(f"'{r}'" for r in v) + ")", "Low") for k, v in LITERAL_REGIONS.items()}
FACT_RULES["forced-parameterization/like-pattern-literal"] = ("pred", "b = 'like' and array_contains(f,'r:literal')", "Low")
FACT_RULES["forced-parameterization/convert-style-code-literal"] = ("cast", "c rlike '^[0-9]+$'", "Low")
