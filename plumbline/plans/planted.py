"""A corpus with planted findings: for each rule a module on which it fires and a clean twin, and the schema they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.rules import catalog_build, engine
from plumbline.rules.catalog_rules import catalog_scan
from plumbline.session import cut

#: ``rule: (a module on which it fires, its clean twin)``. A text that doesn't begin with CREATE is the body of a procedure.
CASES: dict[str, tuple[str, str]] = {
    "tier1/date-function-on-column": ("select 1 from dbo.t where year(d) = 2024", "select 1 from dbo.t where d >= '2024-01-01'"),
    "tier1/case-fold-on-column": ("select 1 from dbo.t where upper(c) = 'A'", "select upper(c) from dbo.t"),
    "tier1/charindex-or-left-on-column": ("select 1 from dbo.t where left(c, 3) = 'abc'", "select 1 from dbo.t where c like 'abc%'"),
    "tier1/column-arithmetic": ("select 1 from dbo.t where a + 1 = 5", "select 1 from dbo.t where a = 5 - 1"),
    "tier1/cast-or-convert-on-column": ("select 1 from dbo.t where cast(c as int) = 5", "select 1 from dbo.t where a = cast('5' as int)"),
    "tier1/leading-wildcard-like": ("select 1 from dbo.t where c like '%x'", "select 1 from dbo.t where c like 'x%'"),
    "tier1/function-wrapped-column": ("select 1 from dbo.t where isnull(c, 0) = 1", "select 1 from dbo.t group by c having max(c) = 1"),
    "deprecated-syntax/equals-null-comparison": ("select 1 from dbo.t where a = null", "select 1 from dbo.t where a is null"),
    "deprecated-syntax/not-equals-null-comparison": ("select 1 from dbo.t where a <> null", "select 1 from dbo.t where a is not null"),
    "deprecated-syntax/non-ansi-comparison-operator": ("select 1 from dbo.t where a != 1", "select 1 from dbo.t where a <> 1"),
    "deprecated-syntax/table-hint-without-with": ("select 1 from dbo.t (nolock)", "select 1 from dbo.t with (nolock)"),
    "deprecated-syntax/string-literal-column-alias": ("select a as 'x' from dbo.t", "select a as x from dbo.t"),
    "deprecated-syntax/deprecated-set-rowcount": ("set rowcount 5", "select top 5 a from dbo.t order by a"),
    "statement-shape/insert-without-column-list": ("insert into dbo.t values (1)", "insert into dbo.t (a) values (1)"),
    "statement-shape/ordinal-order-by": ("select a from dbo.t order by 1", "select a from dbo.t order by a"),
    "statement-shape/bare-select-star": ("select * from dbo.t", "select count(*) from dbo.t"),
    "query/unbounded-table-write": ("delete from dbo.t", "delete from dbo.t where a = 1"),
    "query/bare-top-no-order-by": ("select top 5 a from dbo.t", "select top 5 a from dbo.t order by a"),
    "query/merge-missing-holdlock": ("merge dbo.t using dbo.s on t.a = s.a when matched then delete;", "merge dbo.t with (holdlock) using dbo.s on t.a = s.a when matched then delete;"),
    "query/recursive-cte-missing-maxrecursion": ("with r as (select 1 as n union all select n + 1 from r) select n from r", "with r as (select 1 as n) select n from r"),
    "query/union-of-provably-disjoint-branches": ("select a from dbo.t where k = 'x' union select a from dbo.t where k = 'y'", "select a from dbo.t where k = 'x' union all select a from dbo.t where k = 'y'"),
    "query/count-star-variable-existence-check": ("declare @n int; set @n = (select count(*) from dbo.t) if @n > 0 print 'x'", "declare @n int; set @n = (select count(*) from dbo.t) if @n > 5 print 'x'"),
    "lineage/multi-referenced-cte": ("with c as (select a from dbo.t) select 1 from c join c as d on c.a = d.a", "with c as (select a from dbo.t) select 1 from c"),
    "window-frame/implicit-default-range": ("select sum(a) over (order by b) from dbo.t", "select row_number() over (order by b) from dbo.t"),
    "window-frame/explicit-range": ("select sum(a) over (order by b range unbounded preceding) from dbo.t", "select sum(a) over (order by b rows unbounded preceding) from dbo.t"),
    "control-flow/empty-catch-block": ("begin try select 1 end try begin catch end catch", "begin try select 1 end try begin catch throw end catch"),
    "control-flow/goto-usage": ("goto done\ndone:\nprint 'x'", "print 'x'"),
    "control-flow/legacy-identity-intrinsic": ("select @@identity", "select scope_identity()"),
    "control-flow/case-expression-missing-else": ("select case a when 1 then 2 end from dbo.t", "select case a when 1 then 2 else 3 end from dbo.t"),
    "control-flow/dirty-read-isolation-hint": ("select 1 from dbo.t with (nolock)", "select 1 from dbo.t with (updlock)"),
    "duplication/self-assignment": ("set @a = @a", "set @a = @a + 1"),
    "duplication/identical-binary-operands": ("select 1 from dbo.t where a = a", "select 1 from dbo.t where a = b"),
    "duplication/mutually-exclusive-and-condition": ("select 1 from dbo.t where a > 5 and a < 3", "select 1 from dbo.t where a > 5 or a < 3"),
    "duplication/redundant-and-condition": ("select 1 from dbo.t where a > 5 and a > 3", "select 1 from dbo.t where a > 5 and b > 3"),
    "duplication/duplicate-sibling-condition": ("if @a = 1 print 'x' else if @a = 1 print 'y'", "if @a = 1 print 'x' else if @a = 2 print 'y'"),
    "duplication/all-branches-identical": ("select case a when 1 then 2 else 2 end from dbo.t", "select case a when 1 then 2 else 3 end from dbo.t"),
    "duplication/collapsible-nested-if": ("if @a = 1 begin if @b = 'x' print 'y' end", "if @a = 1 begin if @b = 'x' print 'y' print 'z' end"),
    "duplication/duplicated-string-literal": ("select 'abcdef', 'abcdef', 'abcdef'", "select 'abcdef', 'abcdef'"),
    "dead-code/unused-local-variable": ("declare @x int", "declare @x int; set @x = 1; select @x"),
    "dead-code/unreachable-code": ("begin return\nselect 1 end", "if @a = 1 return\nselect 1"),
    "dead-code/unused-label": ("done:\nprint 'x'", "goto done\ndone:\nprint 'x'"),
    "security/hard-coded-credential": ("declare @password varchar(20) = 'hunter2'", "declare @colour varchar(20) = 'red'"),
    "security/hard-coded-ip-address": ("select 1 from dbo.t where h = '10.4.5.6'", "select 1 from dbo.t where h = '127.0.0.1'"),
    "security/weak-hash-algorithm": ("select hashbytes('MD5', @b)", "select hashbytes('SHA2_256', @b)"),
    "dynamic-sql/unanalyzable": ("exec('select ' + @b)", "exec('select 1')"),
    "session-date/set-datefirst": ("set datefirst 1", "set language english"),
    "join/cartesian-comma-join": ("select 1 from dbo.t, dbo.u", "select 1 from dbo.t, dbo.u where t.a = u.a"),
    "join/outer-join-predicate-collapse": ("select 1 from dbo.t left join dbo.u on t.a = u.a where u.b = 1", "select 1 from dbo.t left join dbo.u on t.a = u.a where u.b is null"),
    "temp-table/unindexed-join-operand": ("select a into #x from dbo.t\nselect 1 from dbo.u join #x on u.a = #x.a", "select a into #x from dbo.t\ncreate index i on #x (a)\nselect 1 from dbo.u join #x on u.a = #x.a"),
    "group-by/invalid-select-list-column": ("select a, b from dbo.t group by a", "select a, sum(b) from dbo.t group by a"),
    "predicates/catch-all-parameter": ("select 1 from dbo.t where (c = @a or @a is null)", "select 1 from dbo.t where (c = @a or c is null)"),
    "correctness/between-end-of-period-boundary": ("select 1 from dbo.t where d between '2024-01-01' and '2024-01-31 23:59:59'", "select 1 from dbo.t where d >= '2024-01-01' and d < '2024-02-01'"),
    "query/rbar-single-row-loop-dml": ("while @a < 5 begin update dbo.t set x = 1 where i = @a set @a = @a + 1 end", "update dbo.t set x = 1 where i = @a"),
    "formatting/missing-begin-end": ("if @a = 1 print 'x'", "if @a = 1 begin print 'x' end"),
    "tier1/regexp-pattern-no-literal-prefix": ("select 1 from dbo.t where regexp_like(c, 'abc')", "select 1 from dbo.t where regexp_like(c, '^abc')"),
    "verdict/scan-forced": ("select 1 from dbo.t where c = @n", "select 1 from dbo.t where c = @b"),
    "verdict/range-seek": ("select 1 from dbo.t where w = @n", "select 1 from dbo.t where w = @b"),
    "verdict/operand-clash": ("select 1 from dbo.t where d0 = @tm", "select 1 from dbo.t where d0 = @dt0"),
    "verdict/collation-conflict": ("select 1 from dbo.t join dbo.u on t.c = u.w2", "select 1 from dbo.t join dbo.u on t.c = u.c2"),
    "predicates/oversized-parameter": ("declare @x varchar(50) = @b select 1 from dbo.t where c = @x", "declare @x varchar(20) = @b select 1 from dbo.t where c = @x"),
    "predicates/under-length-parameter": ("select 1 from dbo.t where c = @b", "declare @x varchar(20) = @b select 1 from dbo.t where c = @x"),
    "predicates/local-variable-predicate": ("declare @x int = @a select 1 from dbo.t where a = @x", "select 1 from dbo.t where a = @a"),
    "predicates/float-equality": ("select 1 from dbo.t where fl = 1.5", "select 1 from dbo.t where fl > 1.5"),
    "predicates/xml-operand-not-comparable": ("select 1 from dbo.t where xm = '<a/>'", "select 1 from dbo.t where xm is not null"),
    "predicates/legacy-lob-operand-not-comparable": ("select 1 from dbo.t where tx = 'a'", "select 1 from dbo.t where tx is not null"),
    "predicates/json-operand-not-comparable": ("select 1 from dbo.t where js = '{}'", "select 1 from dbo.t where js is not null"),
    "predicates/spatial-operand-not-comparable": ("select 1 from dbo.t where ge = @b", "select 1 from dbo.t where ge is not null"),
    "predicates/dynamic-data-masking-predicate-exposure": ("select 1 from dbo.t where ma = 'x'", "select ma from dbo.t"),
    "correctness/not-null-predicate-contradiction": ("select 1 from dbo.t where a is null", "select 1 from dbo.t where c is null"),
    "call-graph/argument-type-mismatch": ("exec dbo.callee_of_all @n", "exec dbo.callee_of_all @b"),
    "write-loss/unicode-to-non-unicode": ("declare @x varchar(20) set @x = @n", "declare @x nvarchar(20) set @x = @n"),
    "write-loss/approximate-to-exact-truncation": ("declare @x int set @x = @f", "declare @x float set @x = @f"),
    "write-loss/numeric-scale-narrowing": ("declare @x decimal(9,1), @y decimal(9,3) set @x = @y", "declare @x decimal(9,3), @y decimal(9,1) set @x = @y"),
    "write-loss/temporal-precision-loss": ("declare @x date set @x = @dt", "declare @x datetime set @x = @dt"),
    "write-loss/length-truncation": ("declare @x varchar(5) set @x = @b", "declare @x varchar(10) set @x = @b"),
    "write-loss/temporal-scale-narrowing": ("declare @x datetime2(3), @y datetime2(7) set @x = @y", "declare @x datetime2(7), @y datetime2(3) set @x = @y"),
    "write-loss/temporal-offset-dropped": ("declare @x datetime2, @y datetimeoffset set @x = @y", "declare @x datetimeoffset, @y datetime2 set @x = @y"),
    "dynamic-sql/analyzed": ("exec('select 1')", "exec('select ' + @b)"),
    "dynamic-sql/exec-string-concatenates-parameterizable-value": ("exec('select 1 where 1 = ' + @b)", "exec('select 1')"),
    "tvf-fence/insert-exec": ("insert into dbo.t (a) exec dbo.callee_of_all 'x'", "insert into dbo.t (a) select 1"),
    "deprecated-syntax/legacy-lob-local-variable": ("declare @x ntext", "declare @x nvarchar(max) select @x"),
    "deprecated-syntax/like-with-no-wildcard": ("select 1 from dbo.t where c like 'abc'", "select 1 from dbo.t where c like 'abc%'"),
    "deprecated-syntax/task-comment-todo": ("/* TODO: later */ select 1", "/* later */ select 1"),
    "deprecated-syntax/task-comment-fixme": ("-- FIXME now\nselect 1", "-- fixed\nselect 1"),
    "deprecated-syntax/legacy-system-compatibility-view": ("select 1 from sysobjects", "select 1 from sys.objects"),
    "deprecated-syntax/removed-security-stored-procedure": ("exec sp_addserver 'x'", "exec sp_help 'x'"),
    "deprecated-syntax/numbered-procedure-execution": ("exec dbo.callee_of_all;2 'x'", "exec dbo.callee_of_all 'x'"),
    "deprecated-syntax/legacy-lob-statement": ("readtext dbo.t.tx @ptr 0 10", "select tx from dbo.t"),
    "deprecated-syntax/legacy-lob-function": ("select textptr(tx) from dbo.t", "select datalength(tx) from dbo.t"),
    "query/unqualified-table-reference": ("select 1 from t", "select 1 from dbo.t"),
    "query/linked-server-or-cross-database-reference": ("select 1 from other.dbo.t", "select 1 from dbo.t"),
    "query/merge-unconditional-delete": ("merge dbo.t with (holdlock) using dbo.s on t.a = s.a when matched then delete;", "merge dbo.t with (holdlock) using dbo.s on t.a = s.a when matched and s.b = 1 then delete;"),
    "query/global-cursor-declaration": ("declare cr cursor for select a from dbo.t", "declare cr cursor local for select a from dbo.t"),
    "query/grouping-sets-cardinality-limit-exceeded": ("select 1 from dbo.t group by cube(a,b,c,d,e,f,g,h,i,j,k,l,m)", "select 1 from dbo.t group by cube(a,b,c)"),
    "query/non-aggregate-having-predicate": ("select a from dbo.t group by a having a > 1", "select a from dbo.t group by a having sum(b) > 1"),
    "query/table-variable-stale-estimate-in-loop": ("declare @v table (i int) while @a < 3 begin insert into @v (i) values (1) select @a = count(*) from @v end", "declare @v table (i int) insert into @v (i) values (1) select i from @v"),
    "query/partition-rebuild-number-exceeds-ceiling": ("alter table dbo.t rebuild partition = 15001", "alter table dbo.t rebuild partition = 15"),
    "view/top-percent-order-by-no-op": ("select top 100 percent a from dbo.t order by a", "select top 10 percent a from dbo.t order by a"),
    "window-function/lag-lead-negative-offset": ("select lag(a, -1) over (order by b) from dbo.t", "select lag(a, 1) over (order by b) from dbo.t"),
    "window-function/percentile-out-of-range": ("select percentile_cont(1.5) within group (order by a) over () from dbo.t", "select percentile_cont(0.5) within group (order by a) over () from dbo.t"),
    "window-function/tablesample-percent-out-of-range": ("select a from dbo.t tablesample (150 percent)", "select a from dbo.t tablesample (50 percent)"),
    "string-tvf/string-split-separator-length": ("select value from string_split(@b, 'ab')", "select value from string_split(@b, 'a')"),
    "string-tvf/string-split-enable-ordinal-not-constant": ("select value from string_split(@b, 'a', @a)", "select value from string_split(@b, 'a', 1)"),
    "string-tvf/string-split-enable-ordinal-value": ("select value from string_split(@b, 'a', 2)", "select value from string_split(@b, 'a', 0)"),
    "string-tvf/string-split-enable-ordinal-type": ("select value from string_split(@b, 'a', 'x')", "select value from string_split(@b, 'a', 1)"),
    "string-tvf/string-split-argument-type": ("select value from string_split(@a, ',')", "select value from string_split(@b, ',')"),
    "string-builtin/space-truncated": ("select space(9000)", "select space(90)"),
    "string-builtin/replicate-truncated": ("select replicate('ab', 5000)", "select replicate('ab', 40)"),
    "forced-serial/nonparallelizable-intrinsic": ("select object_id('x') from dbo.t", "select object_name(1) from dbo.t"),
    "forced-serial/fast-forward-cursor": ("declare cr cursor local fast_forward for select a from dbo.t", "declare cr cursor local static for select a from dbo.t"),
    "forced-serial/table-variable-modification": ("declare @v table (i int) insert into @v (i) select a from dbo.t", "create table #v (i int) insert into #v (i) select a from dbo.t"),
    "control-flow/waitfor": ("waitfor delay '00:00:01'", "print 'x'"),
    "control-flow/read-committed-lock-reverts-row-versioning": ("select 1 from dbo.t with (readcommittedlock)", "select 1 from dbo.t with (readcommitted)"),
    "control-flow/duplicated-call-argument": ("select coalesce(a, a) from dbo.t", "select coalesce(a, b) from dbo.t"),
    "control-flow/non-deterministic-case-input": ("select case newid() when 'a' then 1 else 2 end", "select case @a when 1 then 1 else 2 end"),
    "control-flow/unresolved-transaction": ("begin tran update dbo.t set a = 1 where b = 2", "begin tran update dbo.t set a = 1 where b = 2 commit"),
    "control-flow/trigger-emits-output": ("create trigger dbo.{p} on dbo.t after insert as select a from inserted", "create trigger dbo.{p} on dbo.t after insert as update dbo.u set c2 = 'x' where w2 = 'y'"),
    "control-flow/unassigned-output-parameter": ("create procedure dbo.{p} @o int output as set nocount on", "create procedure dbo.{p} @o int output as set @o = 1"),
    "control-flow/cursor-close-on-commit": ("set cursor_close_on_commit on declare cr cursor local for select a from dbo.t open cr begin tran update dbo.t set a = 1 where b = 2 commit", "declare cr cursor local for select a from dbo.t open cr begin tran update dbo.t set a = 1 where b = 2 commit"),
    "control-flow/unresolved-implicit-transaction": ("set implicit_transactions on update dbo.t set a = 1 where b = 2", "set implicit_transactions on update dbo.t set a = 1 where b = 2 commit"),
    "control-flow/commit-after-xact-abort-dooms-transaction": ("set xact_abort on begin tran begin try update dbo.t set a = 1 where b = 2 end try begin catch commit end catch", "set xact_abort on begin tran begin try update dbo.t set a = 1 where b = 2 end try begin catch rollback end catch"),
    "control-flow/truncate-swallowed-by-catch": ("begin try truncate table dbo.t end try begin catch print 'x' end catch", "begin try truncate table dbo.t end try begin catch throw end catch"),
    "control-flow/cursor-fetch-column-count-mismatch": ("declare cr cursor local for select a, b from dbo.t fetch next from cr into @a", "declare cr cursor local for select a from dbo.t fetch next from cr into @a"),
    "duplication/always-true-or-false-literal-comparison": ("select 1 from dbo.t where 1 = 1", "select 1 from dbo.t where a = 1"),
    "duplication/repeated-unary-operator": ("if not not @a = 1 begin print 'x' end", "if not @a = 1 begin print 'x' end"),
    "duplication/negated-comparison-as-opposite": ("select 1 from dbo.t where not (a = 1)", "select 1 from dbo.t where a <> 1"),
    "duplication/identical-branch-bodies": ("select case a when 1 then 2 when 3 then 2 else 4 end from dbo.t", "select case a when 1 then 2 when 3 then 5 else 4 end from dbo.t"),
    "duplication/nested-conditional-expression": ("select iif(@a = 1, iif(@a = 2, 1, 2), 3)", "select iif(@a = 1, 2, 3)"),
    "duplication/single-iteration-loop": ("while @a < 5 begin set @a = @a + 1 break end", "while @a < 5 begin set @a = @a + 1 end"),
    "duplication/commented-out-code": ("/* delete from dbo.t where a = 1; */ select 1", "/* removes what is old */ select 1"),
    "dead-code/unused-parameter": ("create procedure dbo.{p} @unused int as select 1", "create procedure dbo.{p} @used int as select @used"),
    "dead-code/redundant-jump": ("goto nxt\nnxt:\nprint 'x'", "goto nxt\nprint 'y'\nnxt:\nprint 'x'"),
    "security/unprovable-dynamic-sql-text": ("exec(@b)", "exec('select 1')"),
    "security/weak-hash-algorithm-sensitive-context": ("select hashbytes('MD5', @password)", "select hashbytes('MD5', @colour)"),
    "security/external-rest-endpoint-call": ("exec sp_invoke_external_rest_endpoint @url = 'x'", "exec sp_help 'x'"),
    "session-date/set-dateformat": ("set dateformat dmy", "set language english"),
    "session-date/ambiguous-date-literal-conversion": ("select cast('01/02/2024' as date)", "select cast('20240102' as date)"),
    "set-option/numeric-roundabort-on": ("set numeric_roundabort on", "set numeric_roundabort off"),
    "set-option/ansi-warnings-off": ("set ansi_warnings off", "set ansi_warnings on"),
    "set-option/concat-null-yields-null-off": ("set concat_null_yields_null off", "set concat_null_yields_null on"),
    "set-option/ansi-padding-off": ("set ansi_padding off", "set ansi_padding on"),
    "join/cartesian-cross-join": ("select 1 from dbo.t cross join dbo.u", "select 1 from dbo.t join dbo.u on t.c = u.c2"),
    "trigger/logon-trigger-host-name-gate": ("if host_name() = 'x' begin print 'x' end", "select host_name()"),
    "trigger/direct-recursive-trigger": ("create trigger dbo.{p} on dbo.rec after insert as update dbo.rec set a = 1 where a = 2", "create trigger dbo.{p} on dbo.rec2 after insert as update dbo.rec3 set a = 1 where a = 2"),
    "trigger/no-early-out-for-empty-invocation": ("create trigger dbo.{p} on dbo.t after insert as update dbo.u set c2 = 'x' where w2 = 'y'", "create trigger dbo.{p} on dbo.t after insert as if not exists (select 1 from inserted) return update dbo.u set c2 = 'x' where w2 = 'y'"),
    "trigger/multi-row-unsafe-single-row-assignment": ("create trigger dbo.{p} on dbo.t after insert as declare @i int select @i = a from inserted", "create trigger dbo.{p} on dbo.t after insert as declare @i int select @i = a from inserted where a = 1"),
    "trigger/multi-row-unsafe-keyed-dml": ("create trigger dbo.{p} on dbo.t after insert as declare @i int select @i = a from inserted update dbo.u set c2 = 'x' where k = @i", "create trigger dbo.{p} on dbo.t after insert as declare @i int select @i = a from inserted update dbo.u set c2 = 'x' where k = 5"),
    "trigger/instead-of-insert-filtered-no-reject-path": ("create trigger dbo.{p} on dbo.t instead of insert as insert into dbo.t (a) select a from inserted where a > 1", "create trigger dbo.{p} on dbo.t instead of insert as insert into dbo.t (a) select a from inserted where a > 1 throw 50001, 'no', 1"),
    "trigger/update-function-without-value-comparison": ("create trigger dbo.{p} on dbo.t after update as if update(a) begin print 'x' end", "create trigger dbo.{p} on dbo.t after update as if update(a) begin update dbo.u set c2 = 'x' from dbo.u join inserted i on i.a = u.k join deleted d on d.b = u.k where i.a <> d.a end"),
    "graph/pseudo-column-assignment": ("update dbo.t set $node_id = 'x' where a = 1", "update dbo.t set b = 1 where a = 1"),
    "restore/option-conflict": ("restore database x from disk = 'y' with recovery, norecovery", "restore database x from disk = 'y' with recovery"),
    "predicates/for-xml-explicit-inline-xsd": ("select a from dbo.t for xml explicit, xmlschema", "select a from dbo.t for xml auto, xmlschema"),
    "catalog/drop-fixed-database-role": ("drop role db_owner", "drop role my_role"),
    "predicates/full-text-predicate-in-aggregate": ("select sum(case when contains (c, 'x') then 1 else 0 end) from dbo.t", "select sum(a) from dbo.t where contains(c, 'x')"),
    "predicates/openxml-with-clr-type-rejected": ("select * from openxml(@a, 'x') with (g geometry 'g')", "select * from openxml(@a, 'x') with (g int 'g')"),
    "predicates/openrowset-with-legacy-type-rejected": ("select * from openrowset(bulk 'x') with (g text 1) as q", "select * from openrowset(bulk 'x') with (g int 1) as q"),
    "predicates/openrowset-with-clr-type-rejected": ("select * from openrowset(bulk 'x') with (g geography 1) as q", "select * from openrowset(bulk 'x') with (g int 1) as q"),
    "predicates/openrowset-with-xml-rejected": ("select * from openrowset(bulk 'x') with (g xml 1) as q", "select * from openrowset(bulk 'x') with (g int 1) as q"),
    "predicates/legacy-lob-conversion-target": ("select cast(@b as text collate Latin1_General_100_CI_AS_SC)", "select cast(@b as varchar(20) collate Latin1_General_100_CI_AS_SC)"),
    "predicates/xml-schema-collection-notation-type": ("create xml schema collection dbo.x1 as '<xsd:element name=\"a\" type=\"xsd:NOTATION\"/>'", "create xml schema collection dbo.x2 as '<xsd:element name=\"a\" type=\"xsd:string\"/>'"),
    "predicates/xml-schema-collection-id-idref-type": ("create xml schema collection dbo.x3 as '<xsd:element name=\"a\" type=\"xsd:IDREF\"/>'", "create xml schema collection dbo.x4 as '<xsd:element name=\"ID\" type=\"xsd:string\"/>'"),
    "predicates/external-table-unsupported-column-type": ("create external table dbo.e1 (a xml) with (location = 'x')", "create external table dbo.e2 (a int) with (location = 'x')"),
    "naming/redundant-type-qualifier": ("declare @x dbo.money_alias", "declare @x money select @x"),
    "naming/sp-prefix-on-user-routine": ("create procedure dbo.sp_{p} as select 1", "create procedure dbo.{p} as select 1"),
    "naming/unqualified-create": ("create procedure {p} as select 1", "create procedure dbo.{p} as select 1"),
    "naming/reserved-keyword-as-identifier": ("create procedure dbo.[select] as select 1", "create procedure dbo.{p} as select 1"),
    "forced-parameterization/dml-output-list-literal": ("delete from dbo.t output 5 where a = 1", "delete from dbo.t output deleted.a where a = 1"),
    "forced-parameterization/constant-foldable-expression-literal": ("select 1 from dbo.t where a = 2 + 3", "select 1 from dbo.t where a = 5"),
    "forced-parameterization/top-or-paging-literal": ("select top 5 a from dbo.t order by a", "select top (@a) a from dbo.t order by a"),
    "forced-parameterization/select-list-literal": ("select 5 from dbo.t", "select a from dbo.t"),
    "forced-parameterization/having-literal": ("select a from dbo.t group by a having sum(b) > 5", "select a from dbo.t group by a having sum(b) > @a"),
    "forced-parameterization/like-pattern-literal": ("select 1 from dbo.t where c like 'a%'", "select 1 from dbo.t where c like @b"),
    "forced-parameterization/convert-style-code-literal": ("select convert(varchar(10), d, 112) from dbo.t", "select convert(varchar(10), d) from dbo.t"),
    "forced-parameterization/table-sample-size-literal": ("select a from dbo.t tablesample (5 percent)", "select a from dbo.t"),
    "forced-parameterization/order-by-expression-literal": ("select a from dbo.t order by a + 5", "select a from dbo.t order by a"),
    "forced-parameterization/group-by-expression-literal": ("select a + 5 from dbo.t group by a + 5", "select a from dbo.t group by a"),
    "string-builtin/replace-truncated": ("select replace('" + "x" * 8001 + "', 'a', 'b')", "select replace('xx', 'a', 'b')"),
    "metrics/line-too-long": ("select 1 -- " + "x" * 200 + "", "select 1 -- x"),
    "metrics/too-many-parameters": ("create procedure dbo.{p} @p0 int, @p1 int, @p2 int, @p3 int, @p4 int, @p5 int, @p6 int, @p7 int, @p8 int, @p9 int, @p10 int, @p11 int, @p12 int, @p13 int, @p14 int, @p15 int as select 1", "create procedure dbo.{p} @p0 int as select @p0"),
    "metrics/too-many-conditional-operators": ("if @a = 1 or @a = 2 or @a = 3 or @a = 4 or @a = 5 or @a = 6 begin print 'x' end", "if @a = 1 or @a = 2 begin print 'x' end"),
    "metrics/too-many-case-branches": ("select case @a when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 when 5 then 5 when 6 then 6 else 7 end", "select case @a when 1 then 1 else 7 end"),
    "metrics/case-branch-too-long": ("select case @a when 1 then 1\n+ 1\n+ 1\n+ 1\n+ 1\n+ 1\n+ 1 else 7 end", "select case @a when 1 then 1 else 7 end"),
    "metrics/module-too-long": ("select 1" + "\n" * 1001 + "select 2", "select 1"),
    "metrics/routine-too-long": ("select 1" + "\n" * 401 + "select 2", "select 1"),
    "metrics/nesting-too-deep": ("if @a = 1 begin if @a = 1 begin if @a = 1 begin if @a = 1 begin if @a = 1 begin if @a = 1 begin if @a = 1 begin if @a = 1 begin if @a = 1 begin if @a = 1 begin if @a = 1 begin print 'x' end end end end end end end end end end end ", "if @a = 1 begin print 'x' end"),
    "formatting/tab-character": ("select\t1", "select 1"),
    "formatting/multiple-statements-per-line": ("print 'x' print 'y'", "\nprint 'x'\nprint 'y'"),
    "formatting/multiple-declarations-per-line": ("declare @x int, @y int select @x, @y", "declare @x int select @x"),
    "formatting/single-line-conditional-body": ("if @a = 1 print 'x'", "if @a = 1\nprint 'x'"),
    "formatting/dangling-statement-after-unbraced-body": ("\nif @a = 1\n    print 'x'\n        print 'y'", "\nif @a = 1\n    print 'x'\nprint 'y'"),
    "formatting/redundant-parentheses": ("select ((a)) from dbo.t", "select (a + 1) from dbo.t"),
    "formatting/if-following-prior-block-end": ("if @a = 1 begin print 'x' end if @a = 2 begin print 'y' end", "if @a = 1 begin print 'x' end\nif @a = 2 begin print 'y' end"),
    "view/order-by-not-guaranteed": ("create view dbo.{p} as select top 10 a from dbo.t order by a", "create view dbo.{p} as select a from dbo.t"),
    "catalog/dangling-object-reference": ("exec dbo.nobody_has_it", "exec dbo.callee_of_all 'x'"),
    "scalar-udf/in-predicate": ("select 1 from dbo.t where dbo.scalar_fn(a) = 1", "select 1 from dbo.t where a = 1"),
    "scalar-udf/in-select-or-expression": ("select dbo.scalar_fn(a) from dbo.t", "select a from dbo.t"),
    "predicate/natively-compiled-unsupported-builtin": ("create procedure dbo.{p} with native_compilation, schemabinding as begin atomic with (x = 1) select upper('a') end", "create procedure dbo.{p} with native_compilation, schemabinding as begin atomic with (x = 1) select abs(1) end"),
    "predicate/natively-compiled-error-outside-catch": ("create procedure dbo.{p} with native_compilation, schemabinding as begin atomic with (x = 1) select error_number() end", "create procedure dbo.{p} with native_compilation, schemabinding as begin atomic with (x = 1) select abs(1) end"),
    "predicate/natively-compiled-interpreted-callee": ("create procedure dbo.{p} with native_compilation, schemabinding as begin atomic with (x = 1) exec dbo.callee_of_all 'x' end", "create procedure dbo.{p} with native_compilation, schemabinding as begin atomic with (x = 1) select abs(1) end"),
    "predicate/natively-compiled-clr-type": ("create procedure dbo.{p} @g dbo.clr_point with native_compilation, schemabinding as begin atomic with (x = 1) select 1 end", "create procedure dbo.{p} @g int with native_compilation, schemabinding as begin atomic with (x = 1) select @g end"),
    "temp-table/unindexed-where-filter": ("select a into #x from dbo.t\nselect a from #x where a = 1", "select a into #x from dbo.t\ncreate index i on #x (a)\nselect a from #x where a = 1"),
    "query/grouping-argument-not-in-group-by-list": ("select grouping(b) from dbo.t group by a", "select grouping(a) from dbo.t group by a"),
    "group-by/invalid-having-column": ("select a from dbo.t group by a having b > 1", "select a from dbo.t group by a having max(b) > 1"),
    "group-by/invalid-order-by-column": ("select a from dbo.t group by a order by b", "select a from dbo.t group by a order by a"),
    "correctness/not-in-nullable-subquery": ("select 1 from dbo.t where a not in (select nk from dbo.u)", "select 1 from dbo.t where a not in (select nk from dbo.u where nk is not null)"),
    "correctness/nonunique-update-source": ("update x set b = u.nk from dbo.t x join dbo.u u on u.nk = x.a", "update x set b = u.nk from dbo.t x join dbo.u u on u.k = x.a"),
    "query/merge-non-unique-using-source": ("merge dbo.t with (holdlock) using dbo.u on t.a = u.nk when matched then update set b = 1;", "merge dbo.t with (holdlock) using dbo.u on t.a = u.k when matched then update set b = 1;"),
    "query/distinct-masking-join-fanout": ("select distinct t.a from dbo.t join dbo.u on u.nk = t.a", "select distinct t.a from dbo.t join dbo.u on u.k = t.a"),
    "correctness/check-constraint-predicate-contradiction": ("select 1 from dbo.u where ck > 500", "select 1 from dbo.u where ck > 5"),
    "join/always-false-inner-join-predicate": ("select t.c from dbo.t join dbo.u on t.a = u.k and t.a > 5 and t.a < 3", "select t.c from dbo.t join dbo.u on t.a = u.k and t.a > 5"),
    "join/join-predicate-empty-with-where-clause": ("select t.c from dbo.t join dbo.u on t.a = u.k where t.a > 50 and u.k < 10", "select t.c from dbo.t join dbo.u on t.a = u.k where t.a > 5 and u.k < 10"),
    "join/partial-composite-fk": ("select t.a from dbo.child c join dbo.composite p on c.x = p.x", "select t.a from dbo.child c join dbo.composite p on c.x = p.x and c.y = p.y"),
    "index/key-lookup-prone": ("select d, fl from dbo.t where ix1 = 5", "select ix1 from dbo.t where ix1 = 5"),
    "index/json-contains-rewrite-eligible": ("select 1 from dbo.t where json_value(js, '$.a') = 'x'", "select 1 from dbo.t where json_value(c, '$.a') = 'x'"),
    "index-shape/composite-leading-column-unconstrained": ("select p1 from dbo.compix where p2 = 5", "select p1 from dbo.compix where p1 = 5 and p2 = 5"),
    "statistics/no-applicable-statistic-auto-create-disabled": ("select 1 from dbo.t where d = @dt", "select 1 from dbo.t where ix1 = 4"),
    "hint/index-does-not-exist": ("select a from dbo.t with (index(ix_nobody))", "select a from dbo.t with (index(ix_one))"),
    "hint/index-not-seekable": ("select a from dbo.t with (index(ix_one)) where b = 1", "select a from dbo.t with (index(ix_one)) where ix1 = 1"),
    "predicates/filtered-index-parameter-mismatch": ("select fi from dbo.t where fi = @a", "select fi from dbo.t where fi = 7"),
    "query/multi-row-insert-ignore-dup-key-drop": ("insert into dbo.dupkey (a) values (1), (2)", "insert into dbo.dupkey (a) values (1)"),
    "catalog/generated-always-column-explicit-insert": ("insert into dbo.temporal (a, vf) values (1, '2024-01-01')", "insert into dbo.temporal (a) values (1)"),
    "catalog/generated-always-column-explicit-update": ("update dbo.temporal set vf = '2024-01-01' where a = 1", "update dbo.temporal set a = 2 where a = 1"),
    "predicates/always-encrypted-assignment-literal-source": ("insert into dbo.enc (e1) values ('x')", "insert into dbo.enc (e1) values (null)"),
    "predicates/always-encrypted-assignment-state-mismatch": ("update dbo.enc set e1 = plain where id = 1", "update dbo.enc set e1 = e2 where id = 1"),
    "predicates/always-encrypted-order-by": ("select id from dbo.enc order by e1", "select id from dbo.enc order by id"),
    "predicates/change-tracking-encrypted-primary-key": ("alter table dbo.encpk enable change_tracking", "alter table dbo.u enable change_tracking"),
    "predicates/dynamic-data-masking-computed-expression-collapse": ("select ma + 'x' as m2 from dbo.t", "select ma from dbo.t"),
    "predicates/float-order-dependent-aggregate": ("select sum(fl) from dbo.t", "select sum(a) from dbo.t"),
    "predicate/try-cast-computed-column": ("select a from dbo.t where tc = 1", "select tc from dbo.t"),
    "predicate/plus-operator-null-propagation": ("select c + 'x' as cx from dbo.t", "select isnull(c, '') + 'x' as cx from dbo.t"),
    "predicate/aggregate-division-columnstore-batch-mode": ("select sum(case when b = 0 then 0 else a / b end) from dbo.cs", "select sum(a) from dbo.cs"),
    "index-design/columnstore-index-on-dml-target-table": ("update dbo.cs set a = 1 where b = 2", "update dbo.t set b = 1 where a = 2"),
    "query/table-variable-low-compat-estimate": ("declare @v table (i int) select i from @v", "create table #v (i int) select i from #v"),
    "query/table-variable-psp-skip": ("create procedure dbo.{p} @r dbo.tab_type readonly as select 1", "create procedure dbo.{p} @r int as select @r"),
    "dml/self-referencing": ("insert into dbo.t (a) select a from dbo.t", "insert into dbo.t (a) select k from dbo.u"),
    "tvf-fence/correlated-apply": ("select t.a from dbo.t t cross apply dbo.fence_fn(t.a) f", "select t.a from dbo.t t cross apply dbo.inline_fn(t.a) f"),
    "tvf-fence/from-or-join": ("select t.a from dbo.t t join dbo.fence_fn(1) f on f.r = t.a", "select t.a from dbo.t t join dbo.inline_fn(1) f on f.r = t.a"),
    "tvf-fence/standalone": ("select r from dbo.fence_fn(1)", "select r from dbo.inline_fn(1)"),
    "tvf-fence/nested-under-view-or-tvf": ("select r from dbo.v_over_fence", "select r from dbo.inline_fn(1)"),
    "scalar-udf/nested-under-view-or-tvf": ("select r from dbo.v_over_scalar", "select r from dbo.inline_fn(1)"),
    "scalar-udf/in-computed-column-or-constraint": ("create table dbo.{p}_t (a int, c as dbo.scalar_fn(a))", "create table dbo.{p}_t (a int, c as (a + 1))"),
    "lineage/nested-view-depth": ("create view dbo.{p} as select k from dbo.v_level2", "create view dbo.{p} as select k from dbo.u"),
    "lineage/select-star-view": ("select k from dbo.v_star2", "select k, nk, c2, w2, ck from dbo.v_star2"),
    "lineage/post-expansion-join-width": ("select w.a from dbo.v_wide w join dbo.v_wide2 x on x.k = w.a", "select t.a from dbo.t t join dbo.u x on x.k = t.a"),
    "lineage/expression-derived-column": ("select 1 from dbo.v_cast where ck2 = 5", "select 1 from dbo.v_cast where k = 5"),
    "lineage/recursive-cte-anchor-type-mismatch": ("with r as (select cast(1 as int) as n union all select cast(n as bigint) from r) select n from r option (maxrecursion 5)", "with r as (select cast(1 as int) as n union all select cast(n as int) from r) select n from r option (maxrecursion 5)"),
    "call-graph/tvf-argument-type-mismatch": ("select r from dbo.inline_str(@n)", "select r from dbo.inline_str(@b)"),
    "call-graph/sp-executesql-parameter-type-mismatch": ("exec sp_executesql N'select @x', N'@x varchar(5)', @x = @n", "exec sp_executesql N'select @x', N'@x nvarchar(50)', @x = @n"),
    "string-tvf/string-split-ordinality-engine-version": ("select value from string_split(@b, 'a', 1)", "select value from string_split(@b, 'a')"),
    "predicates/revert-cookie-type-mismatch": ("declare @k varchar(100) revert with cookie = @k", "declare @k varbinary(100) revert with cookie = @k"),
    "predicates/execute-at-large-object-parameter-crashes-session": ("declare @l varchar(max) exec('select ?', @l) at remote1", "exec('select ?', @b) at remote1"),
    "predicates/execute-at-xml-parameter-rejected": ("declare @l xml exec('select ?', @l) at remote1", "exec('select ?', @b) at remote1"),
    "predicates/xml-schema-collection-mismatch": ("declare @x xml(dbo.s1), @y xml(dbo.s2) set @x = @y", "declare @x xml(dbo.s1), @y xml(dbo.s1) set @x = @y"),
    "predicates/restricted-implicit-assignment": ("declare @x sql_variant, @y int set @y = @x", "declare @x sql_variant, @y sql_variant set @y = @x"),
    "predicates/vector-function-non-vector-operand": ("select vector_norm(@b, 'norm2')", "declare @v vector(3) select vector_norm(@v, 'norm2')"),
    "predicates/vector-function-dimension-mismatch": ("declare @v vector(3), @w vector(4) select vector_distance('cosine', @v, @w)", "declare @v vector(3), @w vector(3) select vector_distance('cosine', @v, @w)"),
    "predicates/vector-literal-non-numeric-element": ("select cast('[1, x, 3]' as vector(3))", "select cast('[1, 2, 3]' as vector(3))"),
    "predicates/vector-literal-dimension-mismatch": ("select cast('[1, 2]' as vector(3))", "select cast('[1, 2, 3]' as vector(3))"),
    "predicates/reassigned-parameter": ("set @a = 5 select 1 from dbo.t where a = @a", "select 1 from dbo.t where a = @a"),
    "catalog/schemabound-alias-type": ("create function dbo.{p} (@x dbo.money_alias) returns int with schemabinding as begin return 1 end", "create function dbo.{p} (@x money) returns int with schemabinding as begin return 1 end"),
    "dynamic-sql/exec-with-result-sets-column-count-mismatch": ("exec dbo.two_columns with result sets ((a int))", "exec dbo.two_columns with result sets ((a int, b int))"),
    "dynamic-sql/insert-exec-temp-table-column-count-mismatch": ("create table #z (a int) insert into #z (a) exec dbo.two_columns", "create table #z (a int, b int) insert into #z (a, b) exec dbo.two_columns"),
    "catalog/unpivot-exact-type-mismatch": ("select v from dbo.piv unpivot (v for n in (q1, q2)) as up", "select v from dbo.piv unpivot (v for n in (q1, q3)) as up"),
    "catalog/semantic-search-table-not-indexed": ("select 1 from semantickeyphrasetable(dbo.t, *)", "select 1 from semantickeyphrasetable(dbo.docs, *)"),
    "catalog/semantic-search-column-not-indexed": ("select 1 from semantickeyphrasetable(dbo.docs, other)", "select 1 from semantickeyphrasetable(dbo.docs, body)"),
    "query/alter-table-switch-constraint-mismatch": ("alter table dbo.sw1 switch to dbo.sw2", "alter table dbo.sw3 switch to dbo.sw4"),
    "set-option/quoted-identifier-off": ("-- quoted_identifier off\nselect fi from dbo.t where a = 1", "select fi from dbo.t where a = 1"),
    "set-option/ansi-nulls-off": ("-- ansi_nulls off\nselect fi from dbo.t where a = 1", "select fi from dbo.t where a = 1"),
    "correctness/view-check-option-contradiction": ("insert into dbo.v_checked (k, c2) values (1, 'closed')", "insert into dbo.v_checked (k, c2) values (1, 'open')"),
}

#: Tables, views and routines that the cases use, one statement a module.
SCHEMA = [
    "create table dbo.t (a int not null, b int null, c varchar(20) collate SQL_Latin1_General_CP1_CI_AS null, w varchar(20) collate Latin1_General_CI_AS null, d datetime null, d0 date null, fl float null, xm xml null, tx text null, js json null, ge geometry null, ma varchar(20) masked with (function = 'default()') null, ix1 int null, fi int null, tc as (try_cast(c as int)), constraint pk_t primary key clustered (a))",
    "create index ix_one on dbo.t (ix1)",
    "create index ix_fi on dbo.t (fi) where fi = 7",
    "create json index ix_js on dbo.t (js)",
    "create table dbo.u (k int not null, nk int null, c2 varchar(20) collate SQL_Latin1_General_CP1_CI_AS null, w2 varchar(20) collate Latin1_General_BIN null, ck int null, constraint pk_u primary key clustered (k), constraint ck_u check (ck >= 0 and ck <= 100))",
    "create table dbo.composite (x int not null, y int not null, constraint pk_comp primary key (x, y))",
    "create table dbo.child (x int not null, y int not null, constraint fk_child foreign key (x, y) references dbo.composite (x, y))",
    "create table dbo.compix (p1 int, p2 int, p3 int)",
    "create index ix_comp on dbo.compix (p1, p2)",
    "create table dbo.dupkey (a int not null)",
    "create unique index ux_dup on dbo.dupkey (a) with (ignore_dup_key = on)",
    "create table dbo.temporal (a int not null, vf datetime2 generated always as row start not null, vt datetime2 generated always as row end not null)",
    "create table dbo.enc (id int not null, e1 varchar(20) encrypted with (column_encryption_key = k1, encryption_type = deterministic, algorithm = 'x') null, e2 varchar(20) encrypted with (column_encryption_key = k1, encryption_type = deterministic, algorithm = 'x') null, plain varchar(20) null)",
    "create table dbo.encpk (id int encrypted with (column_encryption_key = k1, encryption_type = deterministic, algorithm = 'x') not null, constraint pk_encpk primary key (id))",
    "create table dbo.cs (a int, b int)",
    "create clustered columnstore index cci on dbo.cs",
    "create table dbo.piv (q1 int, q2 bigint, q3 int)",
    "create table dbo.docs (id int not null, body nvarchar(max), other nvarchar(max))",
    "create fulltext index on dbo.docs (body statistical_semantics) key index pk_docs",
    "create table dbo.sw1 (a int)",
    "create table dbo.sw2 (a int, constraint ck_sw2 check (a > 5))",
    "create table dbo.sw3 (a int)",
    "create table dbo.sw4 (a int)",
    "create type dbo.money_alias from decimal(9,2)",
    "create type dbo.clr_point external name geo.point",
    "create procedure dbo.callee_of_all @x varchar(10) as set nocount on",
    "create procedure dbo.two_columns as select k, nk from dbo.u where k = 1",
    "create function dbo.scalar_fn (@x int) returns int as begin return @x end",
    "create function dbo.inline_fn (@x int) returns table as return (select k as r from dbo.u where k = @x)",
    "create function dbo.inline_str (@x varchar(10)) returns table as return (select k as r from dbo.u where c2 = @x)",
    "create function dbo.fence_fn (@x int) returns @r table (r int) as begin insert into @r (r) select k from dbo.u where k = @x return end",
    "create view dbo.v_over_fence as select f.r from dbo.fence_fn(1) as f join dbo.u on u.k = f.r",
    "create view dbo.v_over_scalar as select dbo.scalar_fn(k) as r from dbo.u",
    "create view dbo.v_level1 as select k, nk, c2 from dbo.u",
    "create view dbo.v_level2 as select k, nk from dbo.v_level1",
    "create view dbo.v_star1 as select k, nk, c2, w2, ck from dbo.u",
    "create view dbo.v_star2 as select * from dbo.v_star1",
    "create view dbo.v_wide as select t.a from dbo.t join dbo.u on u.k = t.a join dbo.composite p on p.x = t.a join dbo.child h on h.x = t.a",
    "create view dbo.v_wide2 as select u.k from dbo.u join dbo.enc e on e.id = u.k join dbo.compix i on i.p1 = u.k",
    "create view dbo.v_cast as select k, cast(ck as bigint) as ck2 from dbo.u",
    "create view dbo.v_checked as select k, c2 from dbo.u where c2 = 'open' with check option",
]

#: ``rule: (DDL that fires, clean DDL)``; ``{t}`` is the table of the case.
CATALOG_CASES: dict[str, tuple[str, str]] = {
    "catalog/column-collation-drift": ("create table {t} (a varchar(5) collate Latin1_General_BIN)", "create table {t} (a varchar(5) collate SQL_Latin1_General_CP1_CI_AS)"),
    "catalog/max-typed-column": ("create table {t} (a varchar(max))", "create table {t} (a varchar(100))"),
    "catalog/legacy-large-object-column": ("create table {t} (a ntext)", "create table {t} (a nvarchar(max))"),
    "index-design/deprecated-lob-column-type": ("create table {t} (a image)", "create table {t} (a varbinary(max))"),
    "index-design/timestamp-column-naming": ("create table {t} (a timestamp)", "create table {t} (a binary(8))"),
    "catalog/always-encrypted-unsupported-data-type": ("create table {t} (a xml encrypted with (column_encryption_key = k, encryption_type = randomized))", "create table {t} (a int encrypted with (column_encryption_key = k, encryption_type = randomized))"),
    "catalog/always-encrypted-identity-column": ("create table {t} (a int identity(1,1) encrypted with (column_encryption_key = k, encryption_type = deterministic))", "create table {t} (a int encrypted with (column_encryption_key = k, encryption_type = deterministic))"),
    "catalog/always-encrypted-non-enclave-key-column": ("create table {t} (a int encrypted with (column_encryption_key = k, encryption_type = randomized)) create index ix on {t} (a)", "create table {t} (a int encrypted with (column_encryption_key = k, encryption_type = deterministic)) create index ix on {t} (a)"),
    "catalog/sparse-column-disallowed-type": ("create table {t} (a text sparse null)", "create table {t} (a int sparse null)"),
    "catalog/legacy-lob-utf8-collation": ("create table {t} (a text collate Latin1_General_100_CI_AS_SC_UTF8)", "create table {t} (a text collate Latin1_General_CI_AS)"),
    "catalog/non-persisted-computed-column": ("create table {t} (a int, c as (a + 1))", "create table {t} (a int, c as (a + 1) persisted)"),
    "catalog/default-constraint-on-nullable-column": ("create table {t} (a int null default (1))", "create table {t} (a int not null default (1))"),
    "catalog/memory-optimized-unsupported-column-type": ("create table {t} (a xml) with (memory_optimized = on)", "create table {t} (a int) with (memory_optimized = on)"),
    "catalog/memory-optimized-utf8-collation": ("create table {t} (a varchar(9) collate Latin1_General_100_CI_AS_SC_UTF8) with (memory_optimized = on)", "create table {t} (a varchar(9) collate Latin1_General_CI_AS) with (memory_optimized = on)"),
    "catalog/memory-optimized-ledger-conflict": ("create table {t} (a int) with (memory_optimized = on, ledger = on)", "create table {t} (a int) with (memory_optimized = on)"),
    "catalog/memory-optimized-clustered-index": ("create table {t} (a int, index ci clustered (a)) with (memory_optimized = on)", "create table {t} (a int, index ci nonclustered (a)) with (memory_optimized = on)"),
    "catalog/memory-optimized-index-included-columns": ("create table {t} (a int, b int, index ni nonclustered (a) include (b)) with (memory_optimized = on)", "create table {t} (a int, b int, index ni nonclustered (a)) with (memory_optimized = on)"),
    "catalog/memory-optimized-filtered-index": ("create table {t} (a int, index ni nonclustered (a) where a > 1) with (memory_optimized = on)", "create table {t} (a int, index ni nonclustered (a)) with (memory_optimized = on)"),
    "catalog/memory-optimized-schema-only-durability": ("create table {t} (a int) with (memory_optimized = on, durability = schema_only)", "create table {t} (a int) with (memory_optimized = on, durability = schema_and_data)"),
    "catalog/memory-optimized-cross-storage-foreign-key": ("create table {t} (a int references dbo.u (k)) with (memory_optimized = on)", "create table {t} (a int references dbo.u (k))"),
    "catalog/untrusted-foreign-key": ("create table {t} (a int) alter table {t} with nocheck add constraint fk_x foreign key (a) references dbo.u (k)", "create table {t} (a int) alter table {t} with check add constraint fk_x foreign key (a) references dbo.u (k)"),
    "catalog/cascading-foreign-key": ("create table {t} (a int references dbo.u (k) on delete cascade)", "create table {t} (a int references dbo.u (k))"),
    "catalog/cross-table-fk-type-drift": ("create table {t} (a bigint references dbo.u (k))", "create table {t} (a int references dbo.u (k))"),
    "catalog/untrusted-check-constraint": ("create table {t} (a int) alter table {t} with nocheck add constraint ck_x check (a > 5)", "create table {t} (a int) alter table {t} with check add constraint ck_x check (a > 5)"),
    "catalog/check-constraint-null-not-handled": ("create table {t} (a int null check (a > 5))", "create table {t} (a int null check (a > 5 or a is null))"),
    "catalog/check-constraint-on-identity-column": ("create table {t} (a int identity(1,1) not null check (a > 5))", "create table {t} (a int not null check (a > 5))"),
    "statement-shape/table-with-no-primary-key": ("create table {t} (a int)", "create table {t} (a int not null primary key)"),
    "index-design/unindexed-foreign-key": ("create table {t} (a int references dbo.u (k))", "create table {t} (a int references dbo.u (k)) create index ix on {t} (a)"),
    "index-design/duplicate-index": ("create table {t} (a int) create index i1 on {t} (a) create index i2 on {t} (a)", "create table {t} (a int, b int) create index i1 on {t} (a) create index i2 on {t} (b)"),
    "index-design/subsumed-index": ("create table {t} (a int, b int) create index i1 on {t} (a) create index i2 on {t} (a, b)", "create table {t} (a int, b int) create index i1 on {t} (b) create index i2 on {t} (a, b)"),
    "index-design/mergeable-indexes-differing-include-only": ("create table {t} (a int, b int, c int) create index i1 on {t} (a) include (b) create index i2 on {t} (a) include (c)", "create table {t} (a int, b int, c int) create index i1 on {t} (a) include (b) create index i2 on {t} (c) include (b)"),
    "index-design/disabled-index": ("create table {t} (a int) create index i1 on {t} (a) alter index i1 on {t} disable", "create table {t} (a int) create index i1 on {t} (a) alter index i1 on {t} rebuild"),
    "index-design/non-unique-clustered-index": ("create table {t} (a int) create clustered index i1 on {t} (a)", "create table {t} (a int) create unique clustered index i1 on {t} (a)"),
    "index-design/heap-with-nonclustered-indexes": ("create table {t} (a int) create index i1 on {t} (a)", "create table {t} (a int) create clustered index i1 on {t} (a)"),
    "index-design/heap-with-nonclustered-primary-key": ("create table {t} (a int not null, primary key nonclustered (a))", "create table {t} (a int not null, primary key clustered (a))"),
    "index-design/random-clustered-key-guid-default": ("create table {t} (a uniqueidentifier not null default (newid()), primary key clustered (a))", "create table {t} (a uniqueidentifier not null default (newsequentialid()), primary key clustered (a))"),
    "index-design/filter-column-not-in-index": ("create table {t} (a int, b int) create index i1 on {t} (a) where b = 1", "create table {t} (a int, b int) create index i1 on {t} (a) where a = 1"),
    "index-design/float-or-real-index-key-column": ("create table {t} (a float) create index i1 on {t} (a)", "create table {t} (a int) create index i1 on {t} (a)"),
    "index-design/variable-length-key-column-exceeds-key-limit": ("create table {t} (a varchar(2000)) create index i1 on {t} (a)", "create table {t} (a varchar(200)) create index i1 on {t} (a)"),
    "index-design/monotonic-clustered-key-missing-sequential-optimization": ("create table {t} (a int identity(1,1) not null) create unique clustered index i1 on {t} (a)", "create table {t} (a int identity(1,1) not null) create unique clustered index i1 on {t} (a) with (optimize_for_sequential_key = on)"),
    "index-design/row-or-page-locking-disabled": ("create table {t} (a int) create index i1 on {t} (a) with (allow_page_locks = off)", "create table {t} (a int) create index i1 on {t} (a) with (allow_page_locks = on)"),
    "index-design/no-recompute-statistics": ("create table {t} (a int) create statistics s1 on {t} (a) with norecompute", "create table {t} (a int) create statistics s1 on {t} (a)"),
    "catalog/columnstore-unsupported-column-type": ("create table {t} (a xml) create nonclustered columnstore index i1 on {t} (a)", "create table {t} (a int) create nonclustered columnstore index i1 on {t} (a)"),
    "catalog/alter-column-precision-scale-narrowing": ("create table {t} (a decimal(9,4)) alter table {t} alter column a decimal(9,2)", "create table {t} (a decimal(9,2)) alter table {t} alter column a decimal(9,4)"),
    "catalog/alter-column-incompatible-family-conversion": ("create table {t} (a varchar(9)) alter table {t} alter column a varbinary(9)", "create table {t} (a varchar(9)) alter table {t} alter column a varchar(10)"),
    "catalog/alter-column-temporal-offset-dropped": ("create table {t} (a datetimeoffset) alter table {t} alter column a datetime2", "create table {t} (a datetime2) alter table {t} alter column a datetimeoffset"),
    "catalog/online-rebuild-legacy-lob-alter-table": ("create table {t} (a text) alter table {t} rebuild with (online = on)", "create table {t} (a int) alter table {t} rebuild with (online = on)"),
    "catalog/online-rebuild-legacy-lob-alter-index-all": ("create table {t} (a text) alter index all on {t} rebuild with (online = on)", "create table {t} (a int) alter index all on {t} rebuild with (online = on)"),
    "catalog/online-rebuild-legacy-lob-alter-column": ("create table {t} (a text) alter table {t} alter column a varchar(max) with (online = on)", "create table {t} (a int) alter table {t} alter column a bigint with (online = on)"),
    "query/alter-table-switch-column-mismatch": ("create table {t} (a int) create table {t}_to (a bigint) alter table {t} switch to {t}_to", "create table {t} (a int) create table {t}_to (a int) alter table {t} switch to {t}_to"),
    "query/alter-table-switch-index-mismatch": ("create table {t} (a int) create table {t}_to (a int) create index i1 on {t}_to (a) alter table {t} switch to {t}_to", "create table {t} (a int) create table {t}_to (a int) create index i1 on {t}_to (a) create index i1 on {t} (a) alter table {t} switch to {t}_to"),
}
#: Relations that many rules read.
WIDE = {"cat_columns", "cat_indexes", "cat_tables", "cat_checks", "cat_fks"}
#: The database of the cases; the modules that speak of another level or switch find it in the second row.
DATABASES = [("good", "SQL_Latin1_General_CP1_CI_AS", 160, 160, True), ("bad", "SQL_Latin1_General_CP1_CI_AS", 140, 150, False), ("new", "SQL_Latin1_General_CP1_CI_AS", 170, 170, True)]
_HEAD = "create procedure dbo.{p} @a int, @b varchar(10), @n nvarchar(20) = null, @f float = null, @dt datetime = null, @tm time = null, @dt0 date = null as set nocount on; "


def _module(text: str, name: str) -> str:
    text = text.replace("{p}", name)
    return text if text.startswith(("create procedure", "create view", "create function", "create trigger", "create table", "create external", "create xml")) else _HEAD.replace("{p}", name) + text


def corpus() -> list[tuple[int, str, bool, bool]]:
    """``(module_id, definition, uses_quoted_identifier, uses_ansi_nulls)``: the schema, then each rule's two modules."""
    rows = [(k, text, True, True) for k, text in enumerate(SCHEMA)]
    for k, (_, texts) in enumerate(CASES.items()):
        for twin, text in enumerate(texts):
            rows.append((1000 + 2 * k + twin, _module(text, f"m{k}_{'clean' if twin else 'fires'}"), "quoted_identifier off" not in text, "ansi_nulls off" not in text))
    for k, texts in enumerate(CATALOG_CASES.values()):
        for twin, text in enumerate(texts):
            rows.append((5000 + 2 * k + twin, text.replace("{t}", f"cat{k}.{'clean' if twin else 'fires'}"), True, True))
    return rows


def planted(spark: SparkSession) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The corpus, its facts, and the catalog that its own DDL declares."""
    modules = spark.createDataFrame(corpus(), "module_id long, definition string, uses_quoted_identifier boolean, uses_ansi_nulls boolean")
    facts = engine.written_facts(modules)
    catalog = {k: cut(v) if k in WIDE else v for k, v in catalog_build.build(facts).items()}
    catalog["dbconfig"] = spark.createDataFrame(DATABASES, "database_name string, collation string, compat int, engine_default int, auto_create_stats boolean")
    return modules, facts, catalog


def rules_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each module rule: whether it fires on its planted module and whether it is silent on the clean twin."""
    modules, facts, catalog = planted(spark)
    found, broken = engine.scan(modules, facts, catalog=catalog)
    if broken:
        raise RuntimeError("; ".join(broken))
    cases = spark.createDataFrame([(rule, 1000 + 2 * k) for k, rule in enumerate(CASES)], "rule_id string, first long")
    hits = found.where(F.col("rule_id").isin(list(CASES))).select("rule_id", "module_id").distinct()
    j = cases.join(hits, "rule_id", "left").groupBy("rule_id", "first")
    return j.agg(F.coalesce(F.bool_or(F.col("module_id") == F.col("first")), F.lit(False)).alias("fires"), F.coalesce(~F.bool_or(F.col("module_id") == F.col("first") + 1), F.lit(True)).alias("silent_on_twin")).drop("first")


def rules_planted_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the catalog rules, over a catalog built from DDL."""
    catalog = planted(spark)[2]
    found = catalog_scan(spark, catalog | {"dbconfig": catalog["dbconfig"].where("database_name = 'good'")}, list(CATALOG_CASES))
    cases = spark.createDataFrame([(rule, f"cat{k}.") for k, rule in enumerate(CATALOG_CASES)], "rule_id string, prefix string")
    j = cases.join(found, "rule_id", "left").groupBy("rule_id", "prefix")
    fires = F.bool_or(F.col("object").startswith(F.concat("prefix", F.lit("fires"))))
    clean = F.bool_or(F.col("object").startswith(F.concat("prefix", F.lit("clean"))))
    return j.agg(F.coalesce(fires, F.lit(False)).alias("fires"), F.coalesce(~clean, F.lit(True)).alias("silent_on_twin")).drop("prefix")


def _expected(rules) -> str:
    return "SELECT rule_id, true AS fires, true AS silent_on_twin FROM (VALUES " + ", ".join(f"('{r}')" for r in rules) + ") v(rule_id)"


QUERIES = {"rules_planted": rules_planted, "rules_planted_catalog": rules_planted_catalog}
ORACLE = {"rules_planted": _expected(CASES), "rules_planted_catalog": _expected(CATALOG_CASES)}
