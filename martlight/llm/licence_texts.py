"""Term counts of whole licence texts: the 150 commonest terms of each, all of the short ones."""

# fmt: off
TEXTS: tuple[tuple[str, str], ...] = (
    (
        "Apache-2.0",
        "the:100 or:69 of:67 and:46 to:40 license:35 work:34 any:30 you:26 for:24 in:24 by:23 a:22 that:22 "
        "works:19 derivative:18 such:18 as:17 this:17 shall:15 conditions:13 copyright:13 form:13 your:13 not:12 "
        "source:12 on:11 with:11 contributor:10 entity:10 is:10 licensor:10 mean:10 use:10 including:9 may:9 "
        "notice:9 terms:9 under:9 contribution:8 file:8 notices:8 within:8 an:7 other:7 patent:7 apache:6 are:6 "
        "if:6 modifications:6 object:6 otherwise:6 owner:6 additional:5 be:5 behalf:5 but:5 damages:5 distribute:5 "
        "distribution:5 from:5 legal:5 liability:5 provided:5 without:5 2:4 attribution:4 control:4 each:4 "
        "limited:4 must:4 no:4 only:4 own:4 part:4 purposes:4 reproduction:4 required:4 submitted:4 text:4 "
        "thereof:4 unless:4 warranty:4 whether:4 writing:4 0:3 accepting:3 agreed:3 all:3 applicable:3 "
        "authorship:3 charge:3 code:3 communication:3 contributions:3 copy:3 direct:3 distributed:3 do:3 "
        "documentation:3 except:3 excluding:3 files:3 following:3 grant:3 include:3 individual:3 its:3 law:3 "
        "licenses:3 name:3 non:3 permissions:3 purpose:3 s:3 those:3 version:3 warranties:3 1:2 9:2 add:2 "
        "against:2 appendix:2 apply:2 at:2 authorized:2 basis:2 been:2 brackets:2 cause:2 claims:2 contract:2 "
        "definition:2 display:2 either:2 electronic:2 enclosed:2 exclusive:2 express:2 free:2 generated:2 "
        "granted:2 grants:2 has:2 have:2 hereby:2 http:2 implied:2 included:2 inclusion:2"
    ),
    (
        "BSD-2-Clause",
        "the:12 of:11 or:10 and:9 in:6 any:4 this:4 are:3 conditions:3 following:3 including:3 provided:3 use:3 "
        "above:2 binary:2 but:2 contributors:2 copyright:2 disclaimer:2 for:2 implied:2 is:2 liability:2 limited:2 "
        "list:2 must:2 not:2 notice:2 redistributions:2 regents:2 software:2 source:2 to:2 warranties:2 with:2 1:1 "
        "2:1 a:1 advised:1 arising:1 as:1 be:1 business:1 by:1 caused:1 code:1 consequential:1 contract:1 damage:1 "
        "damages:1 data:1 direct:1 disclaimed:1 distribution:1 documentation:1 even:1 event:1 exemplary:1 "
        "express:1 fitness:1 form:1 forms:1 goods:1 however:1 if:1 incidental:1 indirect:1 interruption:1 liable:1 "
        "loss:1 materials:1 merchantability:1 met:1 modification:1 negligence:1 no:1 on:1 other:1 otherwise:1 "
        "out:1 particular:1 permitted:1 possibility:1 procurement:1 profits:1 purpose:1 redistribution:1 "
        "reproduce:1 retain:1 services:1 shall:1 special:1 strict:1 substitute:1 such:1 that:1 theory:1 tort:1 "
        "way:1 whether:1 without:1"
    ),
    (
        "BSD-3-Clause",
        "the:15 of:13 or:11 and:9 in:6 this:5 any:4 are:3 conditions:3 contributors:3 following:3 including:3 "
        "provided:3 software:3 to:3 use:3 above:2 be:2 binary:2 but:2 copyright:2 disclaimer:2 for:2 implied:2 "
        "is:2 liability:2 limited:2 list:2 must:2 not:2 notice:2 redistributions:2 regents:2 source:2 warranties:2 "
        "with:2 without:2 1:1 2:1 3:1 a:1 advised:1 arising:1 as:1 business:1 by:1 caused:1 code:1 consequential:1 "
        "contract:1 damage:1 damages:1 data:1 derived:1 direct:1 disclaimed:1 distribution:1 documentation:1 "
        "endorse:1 even:1 event:1 exemplary:1 express:1 fitness:1 form:1 forms:1 from:1 goods:1 however:1 if:1 "
        "incidental:1 indirect:1 interruption:1 its:1 liable:1 loss:1 materials:1 may:1 merchantability:1 met:1 "
        "modification:1 name:1 names:1 negligence:1 neither:1 no:1 nor:1 on:1 other:1 otherwise:1 out:1 "
        "particular:1 permission:1 permitted:1 possibility:1 prior:1 procurement:1 products:1 profits:1 promote:1 "
        "purpose:1 redistribution:1 reproduce:1 retain:1 services:1 shall:1 special:1 specific:1 strict:1 "
        "substitute:1 such:1 that:1 theory:1 tort:1 university:1 used:1 way:1 whether:1 written:1"
    ),
    (
        "CC0-1.0",
        "the:66 and:55 of:50 or:45 to:29 work:26 any:24 rights:22 in:21 a:18 for:18 affirmer:17 copyright:11 "
        "related:11 s:11 by:10 not:10 as:9 including:9 commons:8 law:8 purpose:8 applicable:7 cc0:7 creative:7 "
        "other:7 this:7 under:7 use:7 waiver:7 without:7 be:6 is:6 license:6 that:6 all:5 an:5 document:5 extent:5 "
        "future:5 legal:5 limitation:5 purposes:5 such:5 works:5 action:4 claims:4 each:4 express:4 i:4 ii:4 no:4 "
        "non:4 on:4 person:4 provided:4 public:4 shall:4 statement:4 with:4 causes:3 commercial:3 disclaims:3 "
        "hereby:3 iii:3 information:3 iv:3 judged:3 makes:3 maximum:3 may:3 owner:3 part:3 thereof:3 those:3 "
        "treaty:3 warranties:3 whatsoever:3 1:2 4:2 absence:2 advertising:2 affected:2 apply:2 are:2 associated:2 "
        "below:2 but:2 case:2 copies:2 cultural:2 current:2 database:2 directive:2 distribute:2 distribution:2 "
        "does:2 duration:2 exclusive:2 exercise:2 extensions:2 free:2 fully:2 further:2 greatest:2 he:2 her:2 "
        "hereunder:2 his:2 ineffective:2 infringement:2 invalid:2 legally:2 limitations:2 medium:2 national:2 "
        "number:2 original:2 otherwise:2 owners:2 permanently:2 permitted:2 promotional:2 protecting:2 reason:2 "
        "respect:2 responsibility:2 reuse:2 scientific:2 she:2 should:2 subject:2 territories:2 these:2 "
        "throughout:2 time:2 upon:2 whether:2 world:2 worldwide:2 0:1 11:1 1996:1 2:1 3:1 9:1 96:1 abandoned:1 "
        "abandons:1 account:1"
    ),
    (
        "GPL-2.0",
        "the:194 to:108 of:104 or:77 you:76 and:72 program:71 a:57 is:53 this:49 license:46 for:39 it:39 any:38 "
        "software:35 that:35 not:34 if:32 in:29 by:28 free:28 on:26 work:24 as:21 your:20 distribute:19 under:19 "
        "copy:18 other:18 terms:18 may:17 with:17 be:16 code:16 distribution:16 public:16 source:16 general:15 "
        "all:14 copyright:14 are:13 conditions:13 version:13 warranty:13 based:12 such:12 have:11 rights:11 "
        "these:11 foundation:10 from:10 which:10 an:9 make:9 modify:9 must:9 section:9 use:9 we:9 2:8 at:8 c:8 "
        "can:8 copies:8 do:8 each:8 gnu:8 no:8 show:8 so:8 will:8 1:7 but:7 distributed:7 either:7 executable:7 "
        "its:7 parties:7 when:7 whole:7 above:6 apply:6 does:6 new:6 notice:6 programs:6 redistribute:6 sections:6 "
        "they:6 also:5 author:5 change:5 charge:5 offer:5 only:5 patent:5 s:5 should:5 system:5 third:5 want:5 "
        "what:5 who:5 works:5 certain:4 copying:4 even:4 everyone:4 form:4 freedom:4 give:4 holder:4 including:4 "
        "intended:4 interactive:4 law:4 licensed:4 licenses:4 made:4 medium:4 modification:4 modified:4 most:4 "
        "object:4 original:4 part:4 permitted:4 provided:4 purpose:4 receive:4 received:4 recipients:4 then:4 "
        "thus:4 without:4 written:4 accompany:3 along:3 announcement:3 applies:3 appropriate:3 b:3 cause:3 "
        "commands:3 complete:3 consequence:3 contains:3 corresponding:3 countries:3 covered:3"
    ),
    (
        "GPL-3.0",
        "the:345 of:221 to:192 a:184 or:151 you:128 license:102 and:98 work:97 that:91 for:86 this:86 in:81 is:70 "
        "it:52 program:52 not:51 any:50 if:49 with:45 under:44 by:43 source:42 covered:41 as:38 code:34 your:34 "
        "terms:32 may:31 on:31 copyright:30 other:30 be:29 from:29 are:28 software:27 an:26 convey:26 copy:25 "
        "public:25 version:25 use:24 corresponding:23 general:23 patent:23 gnu:22 all:21 object:21 product:21 "
        "such:21 which:21 free:20 rights:19 means:18 no:17 but:16 do:16 conveying:15 section:15 user:15 "
        "warranty:15 additional:14 apply:14 conditions:14 copies:14 have:14 make:14 must:14 those:14 versions:14 "
        "can:13 does:13 material:13 modified:13 provided:13 modify:12 party:12 s:12 used:12 works:12 form:11 "
        "legal:11 notices:11 so:11 contributor:10 each:10 holder:10 its:10 law:10 part:10 particular:10 "
        "permission:10 permissions:10 these:10 applicable:9 available:9 either:9 has:9 licenses:9 non:9 "
        "propagate:9 third:9 users:9 appropriate:8 at:8 c:8 charge:8 freedom:8 further:8 including:8 information:8 "
        "making:8 network:8 notice:8 offer:8 only:8 parties:8 receive:8 received:8 run:8 them:8 who:8 will:8 "
        "also:7 authors:7 gpl:7 granted:7 interface:7 liability:7 more:7 new:7 one:7 recipients:7 some:7 "
        "transaction:7 way:7 we:7 when:7 without:7 would:7 1:6 2:6 3:6 access:6 b:6 based:6 been:6 control:6 "
        "designed:6 extent:6"
    ),
    (
        "ISC",
        "or:8 of:5 the:5 and:4 in:4 software:4 this:4 all:3 any:3 is:3 use:3 with:3 action:2 author:2 damages:2 "
        "for:2 notice:2 permission:2 provided:2 to:2 warranties:2 above:1 an:1 appear:1 arising:1 as:1 be:1 "
        "connection:1 consequential:1 contract:1 copies:1 copy:1 copyright:1 data:1 direct:1 disclaims:1 "
        "distribute:1 event:1 fee:1 fitness:1 from:1 granted:1 hereby:1 implied:1 including:1 indirect:1 liable:1 "
        "loss:1 merchantability:1 modify:1 negligence:1 no:1 other:1 out:1 performance:1 profits:1 purpose:1 "
        "regard:1 resulting:1 shall:1 special:1 that:1 tortious:1 whatsoever:1 whether:1 without:1"
    ),
    (
        "LGPL-2.1",
        "the:349 of:160 library:140 to:140 a:123 and:91 you:88 or:80 is:79 that:79 license:76 this:67 work:58 "
        "for:53 it:50 in:45 with:42 not:41 if:40 any:39 by:39 free:36 software:35 as:30 copy:30 on:30 be:29 "
        "public:29 general:27 use:27 other:26 terms:26 version:25 under:24 code:23 distribute:23 must:23 may:21 "
        "these:19 are:18 distribution:17 from:17 gnu:17 such:17 we:17 all:16 based:16 lesser:15 so:15 source:15 "
        "your:15 copyright:14 2:13 can:13 section:13 uses:13 an:12 derivative:12 program:12 1:11 conditions:11 "
        "do:11 executable:11 modified:11 ordinary:11 rights:11 which:11 also:10 does:10 have:10 its:10 make:10 "
        "modify:10 object:10 user:10 warranty:10 will:10 above:9 copies:9 distributed:9 each:9 foundation:9 "
        "freedom:9 libraries:9 programs:9 system:9 application:8 but:8 sections:8 then:8 they:8 when:8 whether:8 "
        "apply:7 at:7 change:7 data:7 either:7 has:7 linked:7 no:7 parties:7 provided:7 s:7 same:7 than:7 who:7 "
        "whole:7 certain:6 complete:6 covered:6 form:6 function:6 made:6 new:6 non:6 notice:6 notices:6 only:6 "
        "part:6 purpose:6 them:6 therefore:6 used:6 works:6 6:5 accompany:5 applies:5 c:5 charge:5 combined:5 "
        "containing:5 contains:5 copying:5 example:5 file:5 files:5 give:5 holder:5 however:5 including:5 into:5 "
        "law:5 link:5 linking:5 means:5 modification:5 more:5 number:5 original:5"
    ),
    (
        "LGPL-3.0",
        "the:114 of:60 a:44 library:34 and:30 version:27 that:26 license:25 work:24 to:22 combined:21 gnu:21 "
        "you:20 is:18 by:17 with:16 for:15 this:15 application:14 or:14 in:13 public:12 code:11 general:11 copy:10 "
        "gpl:10 if:10 under:10 an:9 corresponding:9 lesser:9 may:9 not:9 3:8 any:8 as:8 it:8 source:8 terms:8 "
        "modified:7 on:7 are:6 convey:6 object:6 such:6 use:6 b:5 based:5 but:5 covered:5 do:5 following:5 "
        "information:5 linked:5 section:5 versions:5 6:4 accompany:4 data:4 document:4 each:4 facility:4 "
        "foundation:4 free:4 from:4 notice:4 other:4 provided:4 refers:4 software:4 your:4 additional:3 be:3 "
        "choice:3 conveying:3 copyright:3 facilities:3 form:3 give:3 installation:3 interface:3 its:3 material:3 "
        "minimal:3 new:3 option:3 part:3 prominent:3 provide:3 published:3 received:3 suitable:3 time:3 used:3 "
        "user:3 0:2 1:2 2007:2 4:2 also:2 below:2 both:2 c:2 choose:2 conditions:2 copies:2 defined:2 does:2 "
        "excluding:2 function:2 header:2 later:2 libraries:2 linking:2 manner:2 means:2 mechanism:2 "
        "modifications:2 must:2 notices:2 number:2 one:2 only:2 otherwise:2 permissions:2 portions:2 present:2 "
        "produced:2 proxy:2 revised:2 s:2 same:2 side:2 specified:2 specifies:2 system:2 than:2 together:2 "
        "uncombined:2 uses:2 which:2 will:2 2:1 29:1 4d0:1 4d1:1 5:1 acceptance:1 accessors:1 accompanying:1"
    ),
    (
        "MIT",
        "the:14 or:9 software:9 of:8 to:8 in:6 and:5 is:4 any:3 without:3 a:2 be:2 copies:2 copy:2 copyright:2 "
        "for:2 including:2 notice:2 other:2 permission:2 shall:2 this:2 use:2 above:1 action:1 all:1 an:1 "
        "arising:1 as:1 associated:1 authors:1 but:1 charge:1 claim:1 conditions:1 connection:1 contract:1 "
        "damages:1 deal:1 dealings:1 distribute:1 do:1 documentation:1 event:1 express:1 files:1 fitness:1 "
        "following:1 free:1 from:1 furnished:1 granted:1 hereby:1 holders:1 implied:1 included:1 kind:1 "
        "liability:1 liable:1 limitation:1 limited:1 merchantability:1 merge:1 modify:1 no:1 noninfringement:1 "
        "not:1 obtaining:1 otherwise:1 out:1 particular:1 permit:1 person:1 persons:1 portions:1 provided:1 "
        "publish:1 purpose:1 restriction:1 rights:1 sell:1 so:1 subject:1 sublicense:1 substantial:1 tort:1 "
        "warranties:1 warranty:1 whether:1 whom:1 with:1"
    ),
    (
        "MPL-2.0",
        "the:130 of:115 license:69 or:67 to:62 a:55 you:50 this:49 any:44 software:39 and:36 covered:36 "
        "contributor:35 under:35 such:32 1:30 in:30 form:29 2:27 by:26 that:26 is:23 3:22 for:22 with:22 code:21 "
        "source:20 terms:20 be:18 means:18 if:17 not:17 version:17 may:16 its:14 rights:14 licenses:13 as:12 b:12 "
        "secondary:12 notice:11 section:11 work:11 patent:10 shall:10 5:9 distribute:9 from:9 granted:9 "
        "liability:9 must:9 your:9 10:8 claims:8 contributions:8 limitation:8 no:8 on:8 other:8 s:8 warranty:8 4:7 "
        "all:7 an:7 except:7 executable:7 file:7 including:7 it:7 0:6 comply:6 distribution:6 each:6 either:6 "
        "entity:6 extent:6 grant:6 grants:6 have:6 incompatible:6 larger:6 modifications:6 notices:6 particular:6 "
        "public:6 use:6 versions:6 additional:5 are:5 contribution:5 create:5 damages:5 exhibit:5 has:5 mozilla:5 "
        "new:5 non:5 recipients:5 than:5 then:5 which:5 without:5 alter:4 at:4 basis:4 compliance:4 governed:4 "
        "legal:4 limitations:4 litigation:4 made:4 make:4 more:4 one:4 only:4 otherwise:4 party:4 provided:4 "
        "recipient:4 regulation:4 some:4 steward:4 termination:4 6:3 7:3 above:3 against:3 also:3 attached:3 "
        "available:3 become:3 can:3 combination:3 conditions:3 contract:3 copy:3 copyright:3 described:3 "
        "disclaimer:3 fair:3 general:3 gnu:3 indemnity:3 initial:3 jurisdiction:3 law:3 licensable:3 modified:3 "
        "necessary:3 obtain:3"
    ),
    (
        "Unlicense",
        "the:13 or:10 of:9 in:8 software:8 and:7 this:6 to:6 any:5 for:4 is:4 copyright:3 public:3 a:2 all:2 an:2 "
        "as:2 authors:2 be:2 commercial:2 dedication:2 domain:2 free:2 other:2 purpose:2 use:2 we:2 act:1 action:1 "
        "anyone:1 arising:1 at:1 author:1 benefit:1 binary:1 but:1 by:1 claim:1 code:1 compile:1 compiled:1 "
        "connection:1 contract:1 copy:1 damages:1 dealings:1 dedicate:1 detriment:1 distribute:1 either:1 event:1 "
        "express:1 fitness:1 form:1 from:1 future:1 heirs:1 implied:1 including:1 intend:1 interest:1 into:1 "
        "jurisdictions:1 kind:1 large:1 law:1 laws:1 liability:1 liable:1 limited:1 make:1 means:1 "
        "merchantability:1 modify:1 no:1 non:1 noninfringement:1 not:1 otherwise:1 our:1 out:1 overt:1 "
        "particular:1 perpetuity:1 present:1 provided:1 publish:1 recognize:1 released:1 relinquishment:1 rights:1 "
        "sell:1 shall:1 source:1 successors:1 that:1 tort:1 under:1 unencumbered:1 warranties:1 warranty:1 "
        "whether:1 with:1 without:1"
    ),
)
