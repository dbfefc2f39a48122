"""The adapters' tables as DuckDB SQL, for the oracle."""

RASTERS = """rasters as (select concat('raster_', s_suppkey::varchar) raster_name, (600 + (s_suppkey * 37) % 400)::int width,
  (500 + (s_suppkey * 53) % 300)::int height, 0.05::double * (1 + s_suppkey % 4) gsd,
  (500000 + s_suppkey * 100)::double origin_x, (5800000 - s_suppkey * 50)::double origin_y from supplier)"""

PIXELS = """px as (select vec_id, 'r' || (vec_id // 100) raster_name, (vec_id % 10 * 4)::int x_off, ((vec_id // 10) % 10 * 4)::int y_off, 8 src_w, 8 src_h,
  (pos // 8)::int y, (pos % 8)::int x, least(floor((v::double + 0.6) * 5), 5)::int val, greatest(least(floor((v::double + 0.6) * 212), 255), 0)::int u8
  from (select vec_id, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 pos from embeddings))"""

PREDICTED = PIXELS + """, pred as (select *, case when (vec_id + y * 3 + x * 5) % 7 = 0 then (val + 1) % 6 else val end pred from px)"""

POINTS = """points as (select c_custkey point_id, ((c_custkey * 7919) % 360000)::double / 1000 - 180 lon, ((c_custkey * 104729) % 170000)::double / 1000 - 85 lat from customer)"""

TRIANGLES = """tri as (select o_orderkey feature_id, (o_orderkey % 40)::double x0, (o_custkey % 40)::double y0, (o_orderkey % 40)::double + 7 x1, (o_custkey % 40)::double + 1 y1,
  (o_orderkey % 40)::double + 2 x2, (o_custkey % 40)::double + 6 y2, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end category_index from orders)"""

LAYERED = """lay as (select concat('l', (l_suppkey % 4)::varchar) tile_id, (l_partkey % 32)::int y, (l_orderkey % 32)::int x, (l_linenumber % 3)::int band, (l_suppkey % 5)::int raster_ord,
  max(case when l_returnflag = 'N' then 0 else l_quantity::int end) value from lineitem group by 1, 2, 3, 4, 5)"""

COVER = """cov as (select distinct 10 z, floor((((user_id * 7919) % 360000) / 1000.0::double - 180) / 360.0::double * 1024 + 512)::int x, (user_id % 1024)::int y from events)"""

FILES = """files as (select doc_id file_id, concat('image_pixel_tiles/r', (doc_id // 2 % 7)::varchar, '/width_height_900_900/width_offset_', ((doc_id // 2 % 13) * 450 - 150)::varchar,
  '/height_offset_', ((doc_id // 2 % 11) * 450 - 150)::varchar, case when doc_id % 6 = 1 then '.png.aux.xml' else '.png' end) tile_path from documents)"""

CATEGORIES = """cats(ord, name, palette_index, r, g, b, is_active, is_ignore) as (values (0, 'background', 0, 255, 0, 0, true, false), (1, 'building', 1, 0, 0, 255, true, false),
  (2, 'tree', 2, 0, 255, 0, true, false), (3, 'impervious_surfaces', 3, 255, 255, 255, true, false), (4, 'low_vegetation', 4, 0, 255, 255, true, false),
  (5, 'car', 5, 255, 255, 0, true, false), (6, 'reliable_area', 10, 255, 0, 255, true, false), (7, 'ignore', 255, 0, 0, 0, false, true))"""
